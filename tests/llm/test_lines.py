"""Fuzzy line removal against all pairs of lines."""

import random

import numpy as np
import xxhash

from leadspark.llm import lines
from leadspark.llm.queries import op5_fuzzy_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def fp(words):
    hs = [xxhash.xxh64_intdigest(w) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4, least=0.8):
    """The deduplicated rows (key, text), in the order of input."""
    places = []
    for at, (key, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            if line.split():
                places.append((at, k, " ".join(line.lower().split())))
    distinct = sorted({p[2] for p in places})
    group = {n: n for n in distinct}
    prints = {n: fp(set(n.split())) for n in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius and group[a] != group[b] and distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9:
                old, new = group[a], group[b]
                group = {n: new if g == old else g for n, g in group.items()}
    return places, group


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(600):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 40)))
        b = "".join(rng.choice("abé ") if rng.random() < 0.2 else c for c in a)[: rng.randrange(0, 45)]
        right, most = distance(a, b), rng.randrange(0, 20)
        assert lines.edit_distance(a, b, most) == min(right, most + 1)
    assert lines.similar("abcde", "abcdx", 0.8) and not lines.similar("abcd", "abcx", 0.8) and lines.similar("", "", 0.8)


def test_line_hashes_of_short_and_long_lines():
    rng = random.Random(1)
    lists = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)] for n in [1, 2, 3, 254, 255, 256, 1000, 5]]
    got = lines.line_hashes([w for x in lists for w in x], [len(x) for x in lists], lines._Hashes())
    assert [int(x) & (2**64 - 1) for x in got] == [fp(x) for x in lists] and got.dtype == np.int64


def rows_with_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    stock = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(60)]
    rows = []
    for key in range(120):
        own = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(stock)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            own.append(rng.choice([line, line.upper(), line + "  ", ""]))
        rows.append((key, "\n".join(own)))
    return rows + [(None, "only here\nw1 w2"), (500, None), (501, ""), (502, "\n \n"), (503, "same\nrow"), (503, "same\nrow"), (504, "the end")]


def test_query_against_all_pairs(spark, tmp_path):
    rows = rows_with_copies()
    spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, n_lines int").write.parquet(f"{tmp_path}/documents.parquet")
    out = op5_fuzzy_lines(spark, str(tmp_path)).collect()
    places, group = brute(rows)
    assert len(out) == len(rows)
    assert sum(r.n_lines for r in out) == len(places)
    left = [" ".join(line.lower().split()) for r in out for line in (r.text or "").split("\n") if line.split()]
    # one occurrence of each group stays, the first
    assert sorted(group[n] for n in left) == sorted(set(group.values()))
    first = {}
    for at, k, n in sorted(places, key=lambda p: (rows[p[0]][0] is None, rows[p[0]][0] or 0, p[1])):
        first.setdefault(group[n], (rows[at][0], n))
    assert {(r.doc_id, " ".join(line.lower().split())) for r in out for line in (r.text or "").split("\n") if line.split()} == set(first.values())
    texts = dict(rows)
    assert all(r.n_removed or r.text == texts[r.doc_id] for r in out)


def test_small_tiles_and_parts_agree(spark):
    rows = rows_with_copies(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    a = sorted(map(tuple, lines.dedup_lines(docs).collect()), key=repr)
    b = sorted(map(tuple, lines.dedup_lines(docs, tile=2, part_lines=2).collect()), key=repr)
    assert a == b


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op5_fuzzy_lines(spark, str(tmp_path)).collect() == []
