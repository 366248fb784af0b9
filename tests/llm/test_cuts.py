import numpy as np

from maskloom.llm import splitting


def levels(n, **at):
    out = np.zeros(n + 1, np.int64)
    for k, v in at.items():
        out[int(k[1:])] = v
    return out


def test_boundary_in_the_first_half():
    whole = np.full(1000, splitting.ALIGNED, np.uint8)
    cut = lambda level_at: splitting.cuts(level_at[:1000].astype(np.uint8) | whole, 512, 32)
    assert cut(levels(1000, _100=1, _150=2, _200=2, _210=1))[0] == (0, 200, 2)
    assert cut(levels(1000, _200=4, _300=1))[0] == (0, 300, 1)  # the later half goes first
    assert cut(levels(1000))[0] == (0, 512, 0)
    pieces = cut(levels(1000, _1=1, _200=2))
    assert pieces[-1][1] == 1000 and all(b[0] == max(0, a[1] - 32) and b[1] > a[1] for a, b in zip(pieces, pieces[1:], strict=False))
