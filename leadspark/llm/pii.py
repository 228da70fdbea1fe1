"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay; looser patterns give further candidates. Labelers vote on each
candidate (1 personal data, -1 not, 0 no opinion): the strict pattern, the structure, gazetteers, words of the context
for and against, and the characters at the borders. Expectation-maximisation estimates how reliable each labeler is
for each kind, and gives each pattern of votes a probability. A logistic span classifier is trained on these
probabilities with votes, kind and shape as features, and decides which candidates become further spans.

Both fits need only how often each combination of kind, votes and shape occurs. There are at most
``4 * 3**6 * SHAPES`` of them, so all candidates of the corpus count and what the driver sees stays bounded.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import with_columns

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ["pattern", "structure", "gazetteer", "context", "against", "border"]
SHAPES = 8
CONTEXT = 48  # characters on either side that context labelers see

# Words that speak for a kind, in English, German, French and Spanish.
FOR = [
    {"mail", "email", "e-mail", "contact", "write", "kontakt", "schreiben", "courriel", "contacter", "écrire", "correo", "contacto", "escribir"},
    {"ip", "host", "server", "address", "login", "adresse", "serveur", "servidor", "dirección", "anmeldung", "connexion", "conexión"},
    {"card", "visa", "mastercard", "credit", "payment", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "pago"},
    {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "anrufen", "handy", "téléphone", "appeler", "teléfono", "llamar", "móvil"},
]
# Words that speak against every kind.
AGAINST = {"version", "release", "isbn", "issn", "order", "invoice", "serial", "section", "chapter", "page", "doi", "bestellung", "rechnung", "seite", "commande", "facture", "pedido", "factura", "página"}
# Top-level domains and mail hosts.
DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl", "pl", "be", "pt", "mx", "ar", "br", "ca", "au", "jp", "in", "cn", "ru"}
# Calling codes.
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match starts where a run of digits starts: within a run it would have started earlier
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start; failing matches are dropped without retries."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        # the local part runs back to the first other character, or to the end of the match before
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((EMAIL, start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((IP, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((CARD, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(digits_of(m[0])) <= 15:
                    out.append((PHONE, m.start(), m.end()))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which overlaps a base span or another."""
    found = []
    if "at)" in text or "at]" in text:
        found += [(EMAIL, m.start(), m.end()) for m in _SPELT.finditer(text)]
    if _DIGIT.search(text):
        found += [(CARD, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(digits_of(m[0])) <= 15]
        found += [(PHONE, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        if text.count(":") >= 7:
            found += [(IP, m.start(), m.end()) for m in _IP6.finditer(text)]
    merged: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts, out, free = [s for s, _ in merged], [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        k = bisect.bisect_left(starts, end) - 1  # the last base span that starts before the end
        if start >= free and (k < 0 or merged[k][1] <= start):
            out.append((kind, start, end))
            free = end
    return out


def votes_of(text: str, kind: int, start: int, end: int, base: bool) -> tuple[list[int], int]:
    """The labelers' votes and the shape, a number below ``SHAPES``."""
    span, digits = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = set(_WORD.findall(before.lower())) | set(_WORD.findall(after.lower()))
    if kind == EMAIL:
        host = re.split(r"@|[\[(]at[\])]", span)[-1]
        labels = re.findall(r"[A-Za-z0-9-]+", host)
        labels = [x for x in labels if x != "dot"]
        structure = 1 if labels and labels[-1].isalpha() and len(labels[-1]) >= 2 else -1
        gazetteer = 1 if labels and labels[-1].lower() in DOMAINS else 0
    elif kind == IP:
        parts = span.split(".")
        structure = 1 if ":" in span or all(p == "0" or not p.startswith("0") for p in parts) else -1
        gazetteer = -1 if span in ("0.0.0.0", "127.0.0.1", "255.255.255.255", "1.2.3.4") or parts[0] == "0" else 0
    elif kind == CARD:
        structure = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "456" or digits[:2] in ("34", "37") or "22" <= digits[:2] <= "27" else -1
    else:
        structure = 1 if 10 <= len(digits) <= 13 else -1
        gazetteer = 0 if not span.startswith("+") else 1 if any(digits[:n] in CALLING for n in (1, 2)) else -1
    edges = text[start - 1 : start] + text[end : end + 1]
    border = -1 if any(c.isdigit() or c in "#/=_" for c in edges) else 1
    votes = [1 if base else 0, structure, gazetteer, 1 if near & FOR[kind] else 0, -1 if near & AGAINST else 0, border]
    shape = 4 * (len(span) > 16) + 2 * (len(digits) > 10) + (" " in span)
    return votes, shape


CANDIDATE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
            T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("shape", T.IntegerType()),
        ]
    )
)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """``docs`` with an array of candidates (kind, start, end, base, votes, shape) in code points, by kind and start.

    A null text counts as empty. A column already called ``name`` is replaced; repeated rows are independent.
    """

    def make():
        def function(batch: pa.RecordBatch) -> list:
            out = []
            for value in batch.column(batch.schema.get_field_index(text)):
                value = value.as_py() or ""
                base = base_spans(value)
                spans = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(value, base)]
                row = []
                for kind, start, end, strict in sorted(spans):
                    votes, shape = votes_of(value, kind, start, end, strict)
                    row.append({"kind": kind, "start": start, "end": end, "base": strict, "votes": votes, "shape": shape})
                out.append(row)
            return [out]

        return function

    return with_columns(docs.withColumn(text, F.col(text).cast("string")), [T.StructField(name, CANDIDATE)], make)


@dataclass(frozen=True)
class Model:
    """Per kind the share of true candidates and each labeler's reliability, and the classifier's weights."""

    prior: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))
    reliability: list[list[float]] = field(default_factory=lambda: [[0.8] * len(LABELERS)] * len(KINDS))
    weights: list[float] | None = None

    def probability(self, kind: int, votes: list[int], shape: int) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_features(kind, votes, shape) @ np.array(self.weights), -500, 500))))


def _features(kind: int, votes: list[int], shape: int) -> np.ndarray:
    x = np.zeros(len(KINDS) + 2 * len(LABELERS) + 3)
    x[kind] = 1
    for k, v in enumerate(votes):
        if v:
            x[len(KINDS) + 2 * k + (v > 0)] = 1
    x[-3:] = shape >> 2 & 1, shape >> 1 & 1, shape & 1
    return x


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prior, reliability, probability of each row): labelers vote independently given the truth.

    A labeler that has an opinion is right with its reliability, for each kind of its own. Estimates start from 0.8
    and are drawn to it by ten imagined votes, so that labelers without opinions stay defined.
    """
    prior, right = np.full(len(KINDS), 0.5), np.full((len(KINDS), votes.shape[1]), 0.8)
    p = np.full(len(counts), 0.5)
    for _ in range(rounds):
        r = np.clip(right[kinds], 1e-3, 1 - 1e-3)
        odds = np.log(np.clip(prior[kinds], 1e-3, 1 - 1e-3) / np.clip(1 - prior[kinds], 1e-3, 1)) + (votes * np.log(r / (1 - r))).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for k in range(len(KINDS)):
            own = kinds == k
            n = counts[own]
            prior[k] = (5 + (n * new[own]).sum()) / (10 + n.sum())
            said = votes[own] != 0
            agree = np.where(votes[own] > 0, new[own][:, None], 1 - new[own][:, None])
            right[k] = (8 + (n[:, None] * said * agree).sum(axis=0)) / (10 + (n[:, None] * said).sum(axis=0))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return prior, right, p


def logistic(x: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression on probabilities, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (counts * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (p - q)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(found: DataFrame, name: str = "candidates") -> Model:
    """Reliabilities and classifier from all candidates; without any, a model that adds nothing."""
    each = found.select(F.explode(name).alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    rows = sorted((r["kind"], tuple(r["votes"]), r["shape"], r["count"]) for r in each.collect())  # at most 4 * 3**6 * SHAPES
    if not rows:
        return Model()
    kinds, votes, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows], dtype=float)
    prior, right, p = expectation_maximisation(kinds, votes, counts)
    x = np.array([_features(*r[:3]) for r in rows])
    # the classifier learns from shares, as a corpus has many times more of some combinations than others
    return Model(prior.tolist(), right.tolist(), logistic(x, p, np.sqrt(counts)).tolist())


def decide(found: DataFrame, model: Model, name: str = "candidates", spans: str = "spans", least: float = 0.9) -> DataFrame:
    """``found`` with ``spans``: every base candidate and those that the classifier gives ``least`` or more."""

    def make():
        known: dict = {}

        def keep(c: dict) -> bool:
            if c["base"]:
                return True
            key = (c["kind"], tuple(c["votes"]), c["shape"])
            if key not in known:
                known[key] = model.probability(*key) >= least
            return known[key]

        def function(batch: pa.RecordBatch) -> list:
            rows = batch.column(batch.schema.get_field_index(name))
            return [[[{k: c[k] for k in ("kind", "start", "end")} for c in row.as_py() or () if keep(c)] for row in rows]]

        return function

    return with_columns(found, [T.StructField(spans, SPANS)], make)


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``found`` with every span of ``text`` replaced by its kind in brackets; spans that overlap become one."""

    def make():
        def function(batch: pa.RecordBatch) -> list:
            out = []
            for value, row in zip(batch.column(batch.schema.get_field_index(text)), batch.column(batch.schema.get_field_index(spans))):
                value, row = value.as_py(), row.as_py()
                if not value or not row:
                    out.append(value)
                    continue
                parts, at = [], 0
                for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in row):
                    if start >= at:
                        parts += [value[at:start], f"[{KINDS[kind].upper()}]"]
                    at = max(at, end)
                out.append("".join(parts) + value[at:])
            return [out]

        return function

    return with_columns(found.withColumn(text, F.col(text).cast("string")), [T.StructField(text, T.StringType())], make).select(*found.columns)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
