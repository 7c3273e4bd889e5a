"""The bin completion search against brute force and sets with a known best packing."""

import itertools
import random

import numpy as np
import pytest

from brindle.llm import packing


def counted(items, cap):
    return np.bincount(items, minlength=cap + 1) if len(items) else np.zeros(cap + 1, np.int64)


def bins_of(packed, counts):
    """The number of bins, after a check that each item is packed once and no bin overflows."""
    used = np.zeros_like(counts)
    for times, way in packed:
        assert times > 0 and sum(way) < len(counts)
        np.add.at(used, list(way), times)
    assert (used == counts).all()
    return sum(times for times, _ in packed)


def replaceable(way, left_out, room):
    """Straight from the definition: some of ``way`` (or nothing) gives its place to one item at least as large."""
    for size in range(len(way) + 1):
        for some in itertools.combinations(way, size):
            for x in left_out:
                larger = x > sum(some) if size < 2 else x >= sum(some)
                if larger and sum(way) - sum(some) + x <= room:
                    return True
    return False


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_all_undominated_ones_least_waste_first(seed):
    draw = random.Random(seed)
    items = [draw.randint(1, 14) for _ in range(draw.randint(0, 8))]
    room = draw.randint(1, 25)
    got = [way for way in packing.fillings(counted(items, 25), room) if way is not None]
    assert [sum(w) for w in got] == sorted((sum(w) for w in got), reverse=True)
    assert len(set(got)) == len(got)
    expected = set()
    for size in range(len(items) + 1):
        for places in itertools.combinations(range(len(items)), size):
            way = [items[i] for i in places]
            left_out = [x for i, x in enumerate(items) if i not in places]
            if sum(way) <= room and not replaceable(way, left_out, room):
                expected.add(tuple(sorted(way, reverse=True)))
    if room in items:
        assert got == [(room,)]  # dominates all others, those it ties with included
    else:
        assert set(got) == expected


@pytest.mark.parametrize(("cap", "bins", "gap"), [(1000, 20, 0), (1000, 40, 1), (1000, 83, 1), (4096, 50, 1), (4096, 200, 1)])
def test_three_items_fill_each_sequence(cap, bins, gap):
    draw, items = random.Random(cap + bins), []
    for _ in range(bins):
        a = draw.randint(cap // 4 + 1, cap // 2 - 1)
        b = draw.randint(cap // 4 + 1, max(cap // 4 + 1, (cap - a) // 2))
        items += [a, b, cap - a - b]
    counts = counted(items, cap)
    assert packing.least_bins(counts) <= bins
    assert bins_of(packing.pack_lengths(counts), counts) <= bins + gap


@pytest.mark.parametrize("seed", range(3))
def test_sequences_cut_at_random_places_are_found_again(seed):
    draw, items = random.Random(seed), []
    for _ in range(300):
        cuts = sorted(draw.sample(range(1, 4096), draw.randint(1, 8)))
        items += [b - a for a, b in zip([0, *cuts], [*cuts, 4096])]
    counts = counted(items, 4096)
    assert bins_of(packing.pack_lengths(counts), counts) == 300


def test_repeats_are_packed_by_times():
    counts = np.zeros(4097, np.int64)
    counts[[1365, 1366, 2048, 4096]] = [2 * 10**12, 10**12, 10**12, 7]
    packed = packing.pack_lengths(counts)
    assert bins_of(packed, counts) == 10**12 + 5 * 10**11 + 7
    assert len(packed) < 10


def test_frames_that_gave_up_their_sums_go_on_where_they_were(monkeypatch):
    draw = random.Random(5)
    items = [draw.randint(100, 500) for _ in range(60)]
    counts = counted(items, 1000)
    bins = packing.least_bins(counts) + 1
    whole = list(itertools.islice(packing.completions(counts, bins, packing.Budget(400)), 50))
    monkeypatch.setattr(packing, "KEPT", 1)
    assert list(itertools.islice(packing.completions(counts, bins, packing.Budget(400)), 50)) == whole
