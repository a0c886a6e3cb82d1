import random
import re

import pytest

from tesserae.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    return kind == "email" or (13 <= len(d) <= 19 and pii.luhn(d) if kind == "card" else 9 <= len(d) <= 15)


def test_base_spans_by_the_definition():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "@x", ".", "1", "23", ".4", "+", "+1", " ", "-", "(", ")", "256", "4111 1111", "1111111", "é", "c.d", "_", "\n"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        assert pii.identifiers(t) == {k: [m.span() for m in re.finditer(p, t) if holds(k, m[0])] for k, p in BASE.items()}


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail joe.doe (at) example (dot) com now", "email", "joe.doe (at) example (dot) com"),
        ("joe at mail dot example dot com", "email", "joe at mail dot example dot com"),
        ("x joe[at]ex.org y", "email", "joe[at]ex.org"),
        ("jоe@exаmple.com", "email", "jоe@exаmple.com"),
        ("ｊｏｅ＠ｅｘ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘ．ｃｏｍ"),
        ("j​oe@ex.com", "email", "j​oe@ex.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("ip one nine two dot one six eight dot one dot one hm", "ip", "one nine two dot one six eight dot one dot one"),
        ("１９２.168.0.1", "ip", "１９２.168.0.1"),
    ],
)
def test_disguises(text, kind, found):
    base, every = pii.found(text)
    assert found in [text[a:b] for a, b in every[kind]]
    assert set(base[kind]) <= set(every[kind])


def test_plain_text_is_left_alone():
    for t in ("meet at noon dot", "one or two (at) most", "He looked at one dot.", "two one", "a@b", "+1 2", ""):
        assert pii.found(t)[0] == pii.found(t)[1]


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+" * 100_000, "1." * 100_000, "one " * 50_000, "(at" * 50_000):
        pii.found(t)


def test_a_million_spaces_take_linear_time():
    import time

    spaces = " " * 1_000_000
    for t in (f"joe (at) x (dot) org{spaces}", f"joe{spaces}(at){spaces}x (dot) org", f"one{spaces}two{spaces}(", f"joe at {spaces}x dot org{spaces}dot", f"({spaces}at"):
        began = time.process_time()
        pii.found(t)
        assert time.process_time() - began < 10
    assert pii.found("joe (at) x (dot) org  (at)  y (dot) com")[1]["email"] == [(0, 20)]


def plainly(text):
    """Base spans by the definition's patterns as they stand."""
    import re

    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_added_spans_are_those_of_the_plain_text():
    """Every identifier, disguised as a whole, is found where it stands in the disguised text."""
    import random

    rng = random.Random(6)
    disguises = {
        "email": [lambda x: x.replace("@", " (at) ").replace(".", " [dot] "), lambda x: x.replace("@", "@\u200b"), lambda x: x.replace("o", "\u043e"), lambda x: x.replace("@", " at ").replace(".", " dot ")],
        "ip": [lambda x: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in x), lambda x: x.replace(".", "\u2024")],
        "card": [lambda x: " ".join("zero one two three four five six seven eight nine".split()[int(c)] for c in x), lambda x: "\u200b".join(x)],
        "phone": [lambda x: "plus " + " ".join("zero one two three four five six seven eight nine".split()[int(c)] for c in x[1:]), lambda x: x.replace("1", "\u00b9")],
    }
    for kind, plain in (("email", "joe@foo.com"), ("ip", "10.21.131.4"), ("card", "4111111111111111"), ("phone", "+15551550199")):
        for disguise in disguises[kind]:
            for _ in range(5):
                left, right = (" ".join(rng.choice(["der", "say", "wort", "x", "ok"]) for _ in range(rng.randint(1, 9))) + "; " for _ in "ab")
                hidden = disguise(plain)
                text = left + hidden + " ; " + right
                base, every = pii.found(text)
                assert base == plainly(text) and every[kind] == [(len(left), len(left) + len(hidden))], (kind, text)


def test_table(table, empty):
    assert pii.personal_data(empty).count() == 0
    rows = [(1, None), (2, ""), (3, "a@b.co 1.2.3.4 +1 (555) 555-0199; 4111 1111 1111 1111;"), (3, "a@b.co"), (None, "x (at) y (dot) com")]
    got = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.personal_data(table(rows)).collect()))
    assert got == [(0, 0, 0, 0, 0, "email:0:18"), (1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 1, 0, 0, 0, "email:0:6"), (3, 1, 1, 1, 1, "email:0:6,ip:7:14,card:34:53,phone:15:32")]


def test_many_spans_in_one_text_take_linear_time():
    import time

    parts = {"email": ("a{}@b.co", "c{} (at) d (dot) com"), "ip": ("1.2.3.4", "1․2․3․4"), "card": ("4111111111111111;", "4111​111111111111;"), "phone": ("+15551550199;", "+1555155019¹;")}
    for kind, (plain, hidden) in parts.items():
        text = " ; ".join(x.format(i) for i in range(25_000) for x in (plain, hidden))
        began = time.time()
        base, every = pii.found(text)
        assert len(every[kind]) >= 50_000 and len(base[kind]) >= 25_000 and time.time() - began < 20, kind


def test_spans_outside_others():
    import random

    rng = random.Random(3)
    for _ in range(300):
        cuts = sorted(rng.sample(range(40), 10))
        base = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        new = [tuple(sorted(rng.sample(range(41), 2))) for _ in range(8)]
        assert pii.outside(new, base) == [s for s in new if not any(b <= s[0] and s[1] <= e for b, e in base)]
