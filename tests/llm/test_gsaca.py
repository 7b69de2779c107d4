import numpy as np
import pytest

from tidemill.llm.gsaca import lyndon_groups, suffix_arrays


def build(blocks):
    parts, bounds = [], [0]
    for strings in blocks:
        parts.append([0] + [c for s in strings for c in (*[x + 1 for x in s], 0)])
        bounds.append(bounds[-1] + len(parts[-1]))
    return np.array([c for p in parts for c in p], np.int64), np.array(bounds)


@pytest.mark.parametrize("letters", [1, 2, 3, 26, 256])
def test_order_is_right(letters):
    rng = np.random.default_rng(letters)
    blocks = []
    for _ in range(120):
        strings = [bytes(rng.integers(0, letters, rng.integers(1, 60)).tolist()) for _ in range(rng.integers(1, 6))]
        strings += [s[rng.integers(0, len(s)) :] or b"\0" for s in strings[:2]]
        blocks.append(strings)
    blocks += [[b"abababab", b"abab", b"ababababc"], [b"aaaa" * 20, b"aaab" * 9], [b"x"], [b"the that this the that"] * 3]
    text, bounds = build(blocks)
    sa = suffix_arrays(text, bounds)
    flat = text.tolist()

    def suffix(i):
        return tuple(flat[i : flat.index(0, i)])

    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        got = sa[a:b].tolist()
        assert sorted(got) == list(range(a, b))
        keys = [suffix(i) for i in got]
        assert keys == sorted(keys)


def test_lengths_are_lyndon_prefixes():
    rng = np.random.default_rng(9)
    text, bounds = build([[bytes(rng.integers(0, 3, 40).tolist())] for _ in range(20)])
    _, _, length, _ = lyndon_groups(text, bounds)
    flat = text.tolist()
    for i, c in enumerate(flat):
        if c:
            end = flat.index(0, i)
            s = flat[i:end]
            longest = max(n for n in range(1, len(s) + 1) if all(s[:n] < s[k:n] for k in range(1, n)))
            assert length[i] == longest
