import random

import pytest
from pyspark.sql import functions as F

from tidespan.llm import line_dedup as ld

from .helpers import EDGES, documents, prose, with_clashes

W = 8


def brute(rows, min_words=W):
    """Units to delete of each distinct (id, text): windows both ways seen before, then extension against the first place."""
    key = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, ld_key(x)))
    seen, read = {}, {}
    for d in key:
        read[d] = ld.read_lines(d[1])
    for d in key:
        _, code, size = read[d]
        for i in range(len(code)):
            j, n = i, size[i]
            while n < min_words and j + 1 < len(code):
                j += 1
                n += size[j]
            if n >= min_words:
                seen.setdefault(tuple(code[i : j + 1]), []).append((d, i, j))
        for j in range(len(code)):
            i, n = j, size[j]
            while n < min_words and i > 0:
                i -= 1
                n += size[i]
            if n >= min_words and (d, i, j) not in seen.get(tuple(code[i : j + 1]), []):
                seen.setdefault(tuple(code[i : j + 1]), []).append((d, i, j))
    gone = {d: set() for d in key}
    rank = {d: k for k, d in enumerate(key)}
    for places in seen.values():
        places.sort(key=lambda x: (rank[x[0]], x[1]))
        s, si, _ = places[0]
        for d, i, j in places[1:]:
            a, b = read[d][1], read[s][1]
            lo, hi, t = i, j, si - i
            while lo > 0 and lo + t > 0 and a[lo - 1] == b[lo - 1 + t]:
                lo -= 1
            while hi + 1 < len(a) and hi + 1 + t < len(b) and a[hi + 1] == b[hi + 1 + t]:
                hi += 1
            gone[d] |= set(range(lo, hi + 1))
    return gone, read


def ld_key(d):
    """The operator's tie order for rows of one id: its key, as Spark hashes it."""
    return KEYS[d]


KEYS: dict = {}


def corpus(rng):
    shared = ["\n".join(prose(rng, rng.randrange(2, 6)) for _ in range(5)) for _ in range(4)]
    rows = [*EDGES, (60, "a b\n" * 30), (61, "a b\n" * 30), (62, "\n\n  \n")]
    for k in range(40):
        parts = [prose(rng, rng.randrange(1, 12)) for _ in range(6)]
        for _ in range(rng.randrange(3)):
            whole = rng.choice(shared).split("\n")
            a = rng.randrange(3)
            parts.insert(rng.randrange(len(parts)), "\n".join(whole[a : a + rng.randrange(1, 5)]))
        rows.append((100 + k // 2, "\n".join(parts)))
    return rows + [(500, rows[-1][1]), (501, rows[-1][1])]


@pytest.mark.parametrize("size", [0, 300, 2_000_000])
def test_against_brute_force(spark, monkeypatch, size):
    """With a block for each document, for a few, and for all of a partition."""
    monkeypatch.setattr(ld, "BLOCK_BYTES", size)
    rows = corpus(random.Random(1))
    docs = documents(spark, rows)
    KEYS.update({(r["doc_id"], r["text"]): r["k"] for r in docs.select("doc_id", "text", ld._dk("doc_id", "text").alias("k")).collect()})
    gone, read = brute(rows)
    want = []
    for i, t in rows:
        if t is None:
            want.append((str(i), 0, 0, None))
            continue
        at, _, size = read[i, t]
        drop = {at[g] for g in gone[i, t]}
        want.append((str(i), len(drop), sum(size[g] for g in gone[i, t]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)))
    got = [(str(r["doc_id"]), r["n_removed"], r["n_removed_words"], r["text"]) for r in ld.dedup_lines(with_clashes(docs), min_words=W).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in got)


def test_every_line_keeps_a_copy(spark):
    rows = corpus(random.Random(2))
    docs = documents(spark, rows)
    out = ld.dedup_lines(docs, min_words=W)
    lines = lambda df: {" ".join(x.split()) for r in df.collect() for x in (r["text"] or "").split("\n") if x.split()}
    assert lines(out) == lines(docs)


def test_winnowing_guarantee():
    """Two sequences that share a run of at least the window's words select a common line in it."""
    rng = random.Random(3)
    for _ in range(200):
        run = [(rng.getrandbits(62), rng.randrange(1, 5)) for _ in range(rng.randrange(3, 9))]
        if sum(n for _, n in run) < 10:
            continue
        pick = []
        for _ in range(2):
            pre = [(rng.getrandbits(62), rng.randrange(1, 5)) for _ in range(rng.randrange(4))]
            every = pre + run + [(rng.getrandbits(62), 2) for _ in range(rng.randrange(4))]
            pick.append({p - len(pre) for _, _, p in ld.windows([c for c, _ in every], [n for _, n in every], 10) if 0 <= p - len(pre) < len(run)})
        assert pick[0] & pick[1]


def test_empty(spark):
    assert ld.dedup_lines(documents(spark, EDGES).where(F.lit(False))).count() == 0


def test_passages_inside_lines(spark):
    """Passages that begin and end inside longer lines go, but for their first place and their ends."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    planted = [fresh(n) for n in (70, 90, 150) for _ in range(5)]
    rows, inside = [], {}
    for k, p in enumerate(planted):
        for d in range(3):
            inside[10 * k + d] = (fresh(rng.randrange(5, 40)), p, fresh(rng.randrange(5, 40)))
            rows.append((10 * k + d, f"  a{k}-{d}  line\n" + " ".join(inside[10 * k + d]) + f"\n\nlast {k}-{d} line"))
    got = {r["doc_id"]: r for r in ld.dedup_lines(documents(spark, rows)).collect()}
    for i, t in rows:
        before, p, after = inside[i]
        n = len(p.split())
        if i % 10 == 0:
            assert got[i]["text"] == t
            continue
        assert n - 4 * ld.CUT + 2 <= got[i]["n_removed_words"] <= n and got[i]["n_removed"] == 0
        assert got[i]["text"].startswith(t.split("\n")[0] + "\n" + before) and got[i]["text"].endswith(after + "\n\n" + t.split("\n")[-1])
        assert len(got[i]["text"].split()) == len(t.split()) - got[i]["n_removed_words"]


def test_units_are_bounded_and_follow_the_words():
    rng = random.Random(5)
    for _ in range(200):
        p = [str(rng.getrandbits(30)).encode() + rng.choice([b"", b"."]) for _ in range(60)]
        found = []
        for _ in range(2):
            pre, post = ([str(rng.getrandbits(30)).encode() for _ in range(rng.randrange(30))] for _ in range(2))
            ends = ld.cuts(pre + p + post)
            assert all(0 < b - a <= 2 * ld.CUT for a, b in zip(ends, ends[1:]))
            found.append({c - len(pre) for c in ends if ld.CUT <= c - len(pre) <= len(p) - ld.CUT})
        assert found[0] == found[1]


def test_short_lines(spark):
    """Lines of MIN_WORDS words go from the second on, shorter ones where FREQUENT documents have them."""
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    whole, often, rare = fresh(ld.MIN_WORDS), "All rights reserved", "see above"
    n = ld.FREQUENT
    rows = [(k, "\n".join([fresh(15), often, fresh(12), *([rare] if k < n - 1 else []), fresh(12), *([whole] if k < 2 else [])])) for k in range(n)]
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(documents(spark, rows)).collect()}
    assert [i for i, t in got.items() if often in t] == [0]
    assert {i for i, t in got.items() if rare in t} == set(range(n - 1))
    assert whole in got[0] and whole not in got[1]


def test_runs_that_go_on_after_their_first_place(spark):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    a, s = fresh(ld.MIN_WORDS), "a short line"
    rows = [(1, a), *((k, f"{fresh(10)}\n{a}\n{s}\n{fresh(10)}") for k in (2, 3, 4))]
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(documents(spark, rows)).collect()}
    assert s in got[2] and s not in got[3] and s not in got[4]


def test_hashes_are_those_of_the_words(monkeypatch):
    """Equal words give equal hashes wherever they stand and however texts are cut into segments; others differ."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    text = "".join(w + rng.choice([" ", "  ", "\t", "\n"]) for w in words * 2)
    found = []
    for segment in (64, 1 << 20):
        monkeypatch.setattr(ld, "SEGMENT", segment)
        w = ld.split_words([text.encode(), text.encode()])
        found.append(ld._word_hashes(w.data, w.buf, w.starts, w.ends).tolist())
    assert found[0] == found[1] and len(set(found[0])) == len(set(words))
    assert found[0][:300] == found[0][300:600] == found[0][900:]


def test_very_long_and_hot(spark):
    """A text of a million words, a line that all documents have, and one with a single endless word."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    hot, long = fresh(12), fresh(300_000)
    rows = [(0, hot), (1, long + "\n" + hot), (2, "x" * 3_000_000 + "\n" + hot), *((k, f"{fresh(20)}\n{hot}") for k in range(3, 300)), (900, long)]
    got = {r["doc_id"]: r for r in ld.dedup_lines(documents(spark, rows)).collect()}
    assert got[0]["text"] == hot and all(got[k]["n_removed_words"] == 12 and hot not in got[k]["text"] for k in range(1, 300))
    assert got[1]["text"] == long and got[2]["text"] == "x" * 3_000_000
    assert len(got[900]["text"].split()) <= 2 * ld.CUT
