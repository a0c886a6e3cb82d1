from tesserae.functions import kernels as K


def test_binary_table():
    assert K.binary_table(2) == [[0, 0], [0, 1], [1, 0], [1, 1]]
    assert len(K.binary_table(5)) == 32


def test_cuboid():
    assert K.cuboid(1, 2, 3) == [[[1.0] * 3] * 2]
