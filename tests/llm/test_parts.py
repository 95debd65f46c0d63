"""Inner parts of the operators against plain sums, exhaustive search and damaged input."""

import gzip
import itertools
import random

import numpy as np
import pytest

from quartermill.llm import quality, sharding, warc


@pytest.fixture(scope="module")
def index():
    return np.concatenate([quality.index_vectors(), np.zeros((1, quality.DIM), np.float32)])


def plain_contexts(index, texts):
    """Every word's row and every shape's: the index vectors of the words and shapes around it; a word's also its own shape's."""
    total = np.zeros(index.shape)
    for ids in texts:
        for t, (word, shape) in enumerate(ids):
            around = sum((index[ids[k, 0]] + index[ids[k, 1]] for k in range(max(0, t - quality.SPAN), min(len(ids), t + quality.SPAN + 1)) if k != t), np.zeros(index.shape[1]))
            total[word] += around + index[shape]
            total[shape] += around
    return total


def spaced(index, texts):
    gap = np.full((quality.SPAN, 2), len(index) - 1)
    return np.concatenate([gap, *itertools.chain.from_iterable((ids, gap) for ids in texts)])


@pytest.mark.parametrize("chunk", [1, 7, 100, None])
def test_contexts_in_fields_equal_a_plain_sum(index, monkeypatch, chunk):
    rng = np.random.default_rng(2)
    if chunk:
        monkeypatch.setattr(quality, "CHUNK", chunk)
    texts = [np.stack([rng.integers(0, 40, n), quality.WORDS + rng.integers(0, 5, n)], axis=1) for n in (0, 1, 2, 5, 90, 300)]
    total = np.zeros(index.shape)
    quality.added_contexts(total, quality.in_fields(index), spaced(index, texts))
    used = np.any(total != 0, axis=1)
    want = plain_contexts(index, texts)
    assert used.sum() > 40 and np.array_equal(total[:-1], want[:-1])


def test_fields_hold_the_largest_sums_of_a_chunk(index):
    """One word repeated: every occurrence adds to one row's fields, the same sign each time."""
    n = quality.CHUNK
    row = int(np.abs(index[: quality.WORDS]).sum(axis=1).argmax())
    same = [s for s in range(quality.WORDS, quality.WORDS + quality.SHAPES) if (index[s] * index[row]).sum() > 0]
    texts = [np.tile([[row, same[0] if same else quality.WORDS]], (n, 1))]
    total = np.zeros(index.shape)
    quality.added_contexts(total, quality.in_fields(index), spaced(index, texts))
    inner, own = n * 2 * quality.SPAN - quality.SPAN * (quality.SPAN + 1), index[row] + index[texts[0][0, 1]]
    assert np.array_equal(total[row], inner * own + n * index[texts[0][0, 1]])
    assert (4 * quality.SPAN + 1) * quality.CHUNK < 1 << 15  # what a field may reach


def test_fields_round_trip():
    x = np.random.default_rng(1).integers(-(1 << 15), 1 << 15, (50, 8))
    assert np.array_equal(quality.from_fields(quality.in_fields(x)), x)


def test_differencing_against_all_partitions():
    """Karmarkar and Karp's largest part is at most 4/3 - 1/(3 m) of the best one's."""
    rng = random.Random(6)
    for _ in range(60):
        m, sizes = rng.choice((2, 3)), [rng.randint(1, 60) for _ in range(rng.randint(1, 8))]
        dealt = sharding.differencing(list(enumerate(sizes)), m)
        assert sorted(dealt) == list(range(len(sizes))) and set(dealt.values()) <= set(range(m))
        largest = max(sum(s for i, s in enumerate(sizes) if dealt[i] == k) for k in range(m))
        best = min(max(sum(s for s, p in zip(sizes, plan) if p == k) for k in range(m)) for plan in itertools.product(range(m), repeat=len(sizes)))
        assert best <= largest <= (4 / 3 - 1 / (3 * m)) * best + 1e-9
    assert sharding.differencing([], 3) == {}


def test_damaged_payloads_are_found():
    raw = gzip.decompress(warc.record(7, "http://a/", "<p>payload é</p>".encode(), "response", None, "2020-01-01T00:00:00Z"))
    assert warc.parsed(raw)[0] == 7 and warc.parsed(raw)[6] == "<p>payload é</p>".encode()
    for damaged in (raw.replace(b"payload \xc3", b"Payload \xc3"), raw.replace(b"<p>pay", b"<p>pa")):
        with pytest.raises(ValueError, match="isn't what its record says"):
            warc.parsed(damaged)
