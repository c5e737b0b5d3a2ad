"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "local_phone", "masked_email", "secret", "social_id")
KINDS = BASE_KINDS + ADDED_KINDS

Span = tuple[str, int, int]

# The base ---------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that does not go on to a dot fails from each of its digits: only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From every @ the local part to the left and the domain to the right: linear, whatever stands around."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The four base kinds, each leftmost and non-overlapping; matches that fail their test are dropped."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Candidates beyond it ---------------------------------------------------------------

_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{8,}+)")
_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def candidates(text: str, base: list[Span]) -> list[Span]:
    """The base spans, and loosely shaped ones that lie clear of them."""
    loose: list[Span] = []
    lowered = text.lower() if any(c in text for c in "=:") else ""
    if "token" in lowered or "secret" in lowered or "passw" in lowered or "key" in lowered:
        loose += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    if "at]" in text or "at)" in text:
        loose += [("masked_email", m.start(), m.end()) for m in _MASKED.finditer(text)]
    if "-" in text or "(" in text:
        loose += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        loose += [("social_id", m.start(), m.end()) for m in _SOCIAL.finditer(text)]
    loose += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = list(np.maximum.accumulate([e for _, e in taken])) if taken else []

    def clear(s: int, e: int) -> bool:
        before = int(np.searchsorted(starts, e))
        return not before or reach[before - 1] <= s

    return base + [x for x in loose if clear(x[1], x[2])]


# Labelers ---------------------------------------------------------------------------

# Cue words of the context labeler, and the domain ends and country codes of the gazetteers.
CUES = {
    "email": ("mail", "contact", "write", "schreib", "correo"), "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "carte", "karte", "tarjeta", "visa"), "phone": ("tel", "phone", "call", "fax", "mobil"),
    "iban": ("iban", "konto", "account", "compte", "cuenta"), "local_phone": ("tel", "phone", "call", "fax", "mobil"),
    "masked_email": ("mail", "contact", "write", "schreib", "correo"), "secret": ("token", "secret", "passw", "key"),
    "social_id": ("ssn", "social", "insurance", "security"),
}
AGAINST = ("version", "isbn", "issn", "page", "figure", "section", "chapter", "article", "§")
DOMAIN_ENDS = frozenset("com org net edu gov io info biz eu uk de fr es it nl pl ch at be us ca au".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CONTEXT = 40
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")


def _pattern(text: str, span: Span) -> int:
    """The strict form of a kind; every base span has it."""
    kind, start, end = span
    if kind == "secret":
        return int(text[start - 1 : start] in ("'", '"') and text[end : end + 1] == text[start - 1])
    if kind == "local_phone":
        return int(text[start] == "(")
    if kind == "masked_email":
        return int("dot" in text[start:end])
    return int(kind != "social_id")


def _checksum(kind: str, value: str) -> int:
    if kind == "card":
        return 1 if luhn(_digits(value)) else -1
    if kind == "iban":
        flat = value.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
        return 1 if int(turned) % 97 == 1 else -1
    if kind == "social_id":
        area, group, serial = value.split("-")
        return -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    return 0


def _gazetteer(kind: str, value: str) -> int:
    if kind in ("email", "masked_email"):
        return 1 if re.split(r"[^A-Za-z0-9-]+", value)[-1].lower() in DOMAIN_ENDS else -1
    if kind == "iban":
        return 1 if value[:2] in IBAN_COUNTRIES else -1
    if kind == "ip":
        return -1 if value.startswith(("0.", "127.", "255.")) else 1
    return 0


def _shape(kind: str, value: str) -> int:
    digits, letters = len(_digits(value)), sum(c.isalpha() for c in value)
    if kind == "secret":  # keys mix digits and letters, words do not
        return 1 if len(value) >= 16 and digits >= 4 and letters >= 4 else -1
    if kind in ("phone", "local_phone"):
        return 1 if 9 <= digits <= 13 else -1
    if kind == "iban":
        return 1 if digits >= 10 else -1
    if kind in ("card", "social_id"):
        return 1 if len(set(_digits(value))) > 2 else -1
    return 1 if len(value) >= 6 else 0


def votes(text: str, span: Span) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    kind, start, end = span
    value, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    cue = any(c in before for c in CUES[kind])
    context = -1 if not cue and any(c in before for c in AGAINST) else int(cue)
    return (_pattern(text, span), _checksum(kind, value), _gazetteer(kind, value), context, _shape(kind, value))


def features(text: str, span: Span) -> tuple[int, ...]:
    """Kind, votes, and two coarse measures; there are 9 * 3^5 * 4 * 4 different ones at most."""
    kind, start, end = span
    size = end - start
    share = len(_digits(text[start:end])) * 3 // max(1, size)
    return (KINDS.index(kind), *votes(text, span), min(3, size // 8), share)


# Reliabilities and the classifier ---------------------------------------------------


def reliabilities(table: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (chance of every vote by labeler and truth, chance of truth for every pattern).

    `table` has the votes of each pattern, `counts` how many spans show it. Starts from the majority. One imaginary span
    for every vote keeps chances off 0 and 1; a fiftieth of all spans more for votes that tell the truth keeps the two
    classes from changing sides or from parting the kinds.
    """
    truth = 1 / (1 + np.exp(-1.5 * table.sum(axis=1)))
    chances = np.zeros((table.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - truth), counts * truth])
        for k in range(table.shape[1]):
            for v in (-1, 0, 1):
                chances[k, :, v + 1] = (weight * (table[:, k] == v)).sum(axis=1) + 1
            chances[k, [0, 1], [0, 2]] += counts.sum() / 50
        chances /= chances.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        score = np.log(prior)[:, None] + sum(np.log(chances[k, :, table[:, k] + 1]).T for k in range(table.shape[1]))
        truth = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return chances, truth


def _design(rows: np.ndarray) -> np.ndarray:
    """Indicator columns of features, and a constant."""
    parts = [np.ones((len(rows), 1))]
    for column, levels in enumerate([range(len(KINDS)), *[(-1, 0, 1)] * len(LABELERS), range(4), range(4)]):
        parts.append((rows[:, column, None] == np.array(list(levels))[None, :]).astype(float))
    return np.concatenate(parts, axis=1)


def trained(rows: np.ndarray, counts: np.ndarray, truth: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression on the chances that EM gives, by gradient descent with a small penalty."""
    x, share = _design(rows), counts / counts.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-x @ weights)) - truth
        weights -= 2.0 * (x.T @ (share * miss) + 1e-4 * weights)
    return weights


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column("_text").to_pylist():
            if text:
                seen.update(features(text, span) for span in candidates(text, base_spans(text)))
        yield pa.RecordBatch.from_pydict({
            "features": pa.array([list(k) for k in seen], type=pa.list_(pa.int32())), "n": pa.array(list(seen.values()), type=pa.int64()),
        })


def fitted(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Classifier weights learned from all candidate spans of `docs`.

    The votes are counted by feature over every document; what reaches the driver is that table, of bounded size.
    """
    seen = docs.select(F.col(text).alias("_text")).mapInArrow(_counted, "features array<int>, n long")
    rows = seen.groupBy("features").agg(F.sum("n").alias("n")).orderBy("features").collect()
    if not rows:
        return np.zeros(_design(np.zeros((0, 3 + len(LABELERS)), dtype=int)).shape[1])
    table = np.array([r.features for r in rows])
    counts = np.array([float(r.n) for r in rows])
    _, truth = reliabilities(table[:, 1 : 1 + len(LABELERS)], counts)
    return trained(table, counts, truth)


def _spans_of(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans): those of the candidates that the classifier takes."""
    base = base_spans(text)
    more = candidates(text, base)[len(base) :]
    if more:
        scores = _design(np.array([features(text, s) for s in more])) @ weights
        more = [s for s, score in zip(more, scores, strict=True) if score > 0]
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(more, key=order)


def _finder(weights: np.ndarray):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        for batch in batches:
            found = [_spans_of(t, weights) if t else ([], []) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "_row": batch.column("_row"),
                "base": pa.array([as_rows(b) for b, _ in found], type=kind),
                "added": pa.array([as_rows(a) for _, a in found], type=kind),
            })

    return run


def personal_spans(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """(_row: the columns `carry`, base, added) for every row of `docs`; a span is (kind, start, end) in code points.

    Base spans are always kept. Added spans come from loosely shaped candidates clear of the base: pattern, checksum,
    gazetteer, context and shape labelers vote, EM over all spans of the corpus weighs them, and a logistic
    regression on its chances decides. Both passes stay in their rows; nothing but feature counts is shuffled.
    Null and empty texts have no spans, repeated rows have the same ones, an empty corpus fits nothing and adds none.
    """
    weights = fitted(docs, text)
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_text"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = rows.select("_row", F.lit(None).cast(span).alias("base"), F.lit(None).cast(span).alias("added")).schema
    return rows.mapInArrow(_finder(weights), kind)


def span_text(spans) -> object:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
