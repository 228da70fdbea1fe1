"""Licence scans against a plain search of every phrase at every word, on the documents and on odd texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leadspark.llm import licenses
from leadspark.llm.queries import op13_positional_licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(texts):
    """Every field for every text, by comparing each template with the words from each place on."""
    all_words = [words_of(t) for t in texts]
    df = {}
    for words in all_words:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    weight = lambda w: math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1e-9
    out = []
    for words in all_words:
        base = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        labels, score = {label for _, label in base}, 0.0 if not base else 1.0
        for t in licenses.NOTICES:
            want = [w.decode() for w in t.words]
            key = want[t.at : t.at + t.n_key]
            for k in range(len(words) - len(key) + 1):
                if words[k : k + len(key)] == key:
                    start = k - t.at
                    held = sum(weight(w) for p, w in enumerate(want) if 0 <= start + p < len(words) and words[start + p] == w)
                    share = min(held / sum(weight(w) for w in want), 1.0)
                    if share >= t.least:
                        labels.add(t.label)
                        score = max(score, share)
        places = [k for k, _ in base]
        out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    return out


def scanned(rows):
    return [(*tuple(r)[1:-1], round(r.score, 9)) for r in rows]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(op13_positional_licenses(spark, sf_dir).collect())
    assert scanned(rows) == plain([texts[r.doc_id] for r in rows]) and len(rows) == len(texts)
    told = [r.doc_id for r in rows if r.labels]
    assert told and all(re.search(r"(?i)licen|cc by", texts[d]) for d in told)


def odd_texts():
    rng = random.Random(11)
    notices = [" ".join(w.decode() for w in t.words) for t in licenses.TEMPLATES]
    texts = [None, "", " \x00", "MIT", "under the MİT license", "Under THE mit\nLicense", "under the mit-license, under the mit license", "cc by nc cc by nc by nc", "CC BY-NC", "apache license version 20", "xcc by nc"]
    texts += [x.upper() for x in notices] + [" ".join(x.split()[: len(x.split()) // 2]) for x in notices]
    for _ in range(120):
        words = " ".join(rng.sample(notices, 2)).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "license", "é", "mit"])
        texts.append(rng.choice([" ", "\n", ", ", "é "]).join(words))
    texts += ["cc by nc " * 5000, "the mit license under " * 3000, "é" * 10000]
    return texts


def test_odd_texts(spark, tmp_path, monkeypatch):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(0, texts[3]), (None, "cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "7 AS score").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_positional_licenses(spark, str(tmp_path)).collect()
    want = dict(zip([repr(r) for r in rows], plain([t for _, t in rows])))
    by_id = {}
    for (doc, text), fields in zip(rows, plain([t for _, t in rows])):
        by_id.setdefault(doc, []).append(fields)
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (*tuple(r)[1:-1], round(r.score, 9)) in by_id[r.doc_id], (r, by_id[r.doc_id])


def test_chunks_do_not_show(monkeypatch):
    text = "Released under the MIT License, or the Apache License, Version 2.0 " * 40
    whole = [w for part in licenses.chunks(text) for w in part]
    monkeypatch.setattr(licenses, "CHUNK", 7)
    parts = list(licenses.chunks(text))
    assert [w for part in parts for w in part] == whole and len(parts) > 200
    index = licenses.build_index(licenses.TEMPLATES, 0, {})
    n, places, labels, score = licenses.scan_text(text, index)
    assert (n, len(places), labels, score) == (len(whole), 80, {"mit", "apache-2"}, 1.0)


def test_empty_table_and_spans(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_positional_licenses(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(1, "x under the MIT license"), (2, None), (3, "GNU General Public License, version 3")], "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses.spans(docs).collect()) == [(1, "mit", True, 1, 4), (3, "gpl-3", False, 0, 5)]
    kept = licenses.scan(docs.withColumn("labels", F.lit(1)).withColumn("more", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "more", *[f.name for f in licenses.FIELDS]]
