import random
import re
from difflib import SequenceMatcher
from urllib.parse import urlsplit

import pytest

from brindle.operators import alignment
from brindle.plans import linked

SF = "/root/testdata/sf0.001"
SCHEMA = "site string, at long, url string, title string, _place long, alignment string"


def parts(url):
    """Scheme, name of the host and parts of the path; all hosts of these tests have a suffix of one label."""
    split = urlsplit(url.lower())
    return split.scheme, split.netloc, split.netloc.split(".")[-2], [p for p in split.path.split("/") if p]


def tokens(path):
    return {t for p in path for t in re.findall("[a-z0-9]{5,}", p) if any(c.isdigit() for c in t)}


def one_record(x, y):
    (_, _, a, s), (_, _, b, t) = x, y
    if not a or not b:
        return not a and not b
    (_, _, host, path), (_, _, other, way) = parts(a), parts(b)
    if (*parts(a)[:2], path) == (*parts(b)[:2], way):
        return True
    if host != other:
        return False
    if path[-1:] == way[-1:] or tokens(path) & tokens(way):
        return True
    s, t = (" ".join((v or "").split()) for v in (s, t))
    return bool(s and t) and SequenceMatcher(None, t.lower(), s.lower()).ratio() >= 0.82


def brute(left, right):
    out = []
    for site in {r[0] for r in left} | {r[0] for r in right}:
        a, b = ([r for r in sorted(rows, key=lambda r: (r[1], r[2] or "", " ".join((r[3] or "").lower().split()))) if r[0] == site] for rows in (left, right))
        while a or b:
            if not a or not b:
                out += [(site, r[1], None, "missing") for r in a] + [(site, None, r[1], "extra") for r in b]
                break
            hit = one_record(a[0], b[0])
            skips = (len(a) > 1 and one_record(a[1], b[0]), len(b) > 1 and one_record(a[0], b[1]))
            if hit or skips[0] == skips[1]:
                out.append((site, a.pop(0)[1], b.pop(0)[1], "matched" if hit else "forced"))
            elif skips[0]:
                out.append((site, a.pop(0)[1], None, "missing"))
            else:
                out.append((site, None, b.pop(0)[1], "extra"))
    return sorted(out, key=repr)


def made(seed, n):
    """A list and a later capture of it, with records lost, added, moved, renamed, and long stretches of one kind."""
    rng = random.Random(seed)
    names = ["red chair with arms", "blue table of oak", "lamp", "small rug, woven", "shelf for books"]
    left = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, f"https://s.example.com/list/{rng.choice('pqrs')}-{i}", rng.choice(names) + f" {i % 7}") for i in range(n)]
    right = []
    for site, i, url, title in left:
        chance = rng.random()
        if chance < 0.12 or n // 3 < i < n // 3 + 20:
            continue
        if chance < 0.24:
            right.append((site, i, f"https://s.example.com/new/added-{rng.randrange(10**4)}", "something else"))
        if chance > 0.9:
            url = f"https://s.example.com/moved/away-{i}"
        elif chance > 0.8:
            url, title = f"https://t.example.org/other/{i}", None
        right.append((site, i, url, title))
    right += [("hot", n + i, f"https://s.example.com/late/l{i}", "late") for i in range(rng.randrange(30))] + [("only", 5, None, None)]
    return left, right


@pytest.mark.parametrize("seed", range(2))
def test_aligned_equals_one_walk(spark, seed):
    left, right = made(seed, 120)
    frames = [spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA) for rows in (left, right)]
    found = alignment.aligned(*frames, "site", "at", "url", "title", block=[5, 16][seed])
    assert found.columns == ["site", "left_id", "right_id", "alignment"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(left, right)


def test_aligned_of_odd_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    run = lambda a, b: sorted(map(tuple, alignment.aligned(frame(a), frame(b), "site", "at", "url", "title", 2).collect()), key=repr)
    assert run([], []) == []
    assert run([], [("a", 1, "u", None)]) == [("a", None, 1, "extra")]
    assert run([("a", 1, "u", None)], []) == [("a", 1, None, "missing")]
    assert run([("a", None, None, None)], [("a", 7, " ", "x")]) == [("a", None, 7, "matched")]
    same = [("a", 1, "https://x.example.com/p", "t")] * 5
    assert run(same, same[:3]) == [("a", 1, 1, "matched")] * 3 + [("a", 1, None, "missing")] * 2
    long = "z" * 20000
    assert run([("", 1, "https://x.example.com/" + long, long)], [("", 1, "https://x.example.com/b", long)]) == [("", 1, 1, "matched")]


def test_marks(spark):
    url, title = "HTTPS://WWW.Shop.Example.co.uk/List//AB1234-x/item9000/?a=1#b", " A  Chair "
    row = spark.createDataFrame([(url, title), (None, None)], "url string, title string")
    first, none = row.select(*(c.alias(n) for n, c in alignment.marks(row.url, row.title).items())).collect()
    assert tuple(first) == ("https://www.shop.example.co.uk/list/ab1234-x/item9000", "example", "ab1234-x/item9000", "item9000", ["ab1234", "item9000"], "a chair")
    assert tuple(none) == ("", "", "", "", [], "")


def test_captures_aligned_equals_one_walk(spark):
    lists = [[tuple(r) for r in d.collect()] for d in linked.captures(spark, SF)]
    found = linked.captures_aligned(spark, SF)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(*lists)
    assert {r[3] for r in brute(*lists)} == {"matched", "forced", "missing", "extra"}
