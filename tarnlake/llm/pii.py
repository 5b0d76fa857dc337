"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier trained on that decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from heapq import merge
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import arrow_schema, documents, slices, stored

KINDS = ["email", "ip", "card", "phone", "secret", "id"]
EMAIL, IP, CARD, PHONE, SECRET, ID = range(6)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of four numbers can only start where digits start, so the look-behind changes nothing but time.
IP_FORM = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD_FORM = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_FORM = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
SOME = re.compile(r"[0-9@]")

# Candidates beyond the base patterns.
LOOSE = [
    (EMAIL, re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,24}")),
    (PHONE, re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    (ID, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")),
]
# The gazetteer. Words that announce a kind when they stand shortly before it, given names, and places.
HINTS = {
    EMAIL: ["mail", "email", "e-mail", "contact", "write to", "reach", "correo", "courriel"],
    IP: ["ip", "host", "server", "addr", "address", "login", "logged in from"],
    CARD: ["card", "visa", "mastercard", "credit", "payment", "paid with", "karte", "carte", "tarjeta"],
    PHONE: ["phone", "telephone", "tel", "call", "fax", "mobile", "cell"],
    SECRET: ["token", "key", "api_key", "apikey", "secret", "password", "passwd", "bearer", "credential"],
    ID: ["ssn", "social", "social security", "passport", "tax", "identity", "id"],
}
NAMES = [
    "james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "david", "elizabeth", "william", "barbara", "richard", "susan", "joseph", "jessica",
    "thomas", "sarah", "anna", "peter", "maria", "jose", "juan", "carmen", "antonio", "ana", "luis", "laura", "hans", "klaus", "petra", "ursula", "jean", "pierre",
    "marie", "claire", "sophie", "paul", "lucas", "emma", "nguyen", "minh", "lan", "wei", "li", "chen", "ahmed", "fatima", "omar", "aisha",
]
PLACES = [
    "london", "paris", "berlin", "madrid", "rome", "new york", "chicago", "boston", "san francisco", "los angeles", "toronto", "sydney", "hanoi", "tokyo", "delhi",
    "street", "avenue", "road", "suite", "apt", "zip", "calle", "rue", "platz",
]
LABELERS = ["pattern", "checksum", "gazetteer", "context", "shape"]
#: How many values each further feature of a candidate has: its size, a name or place before it, its share of digits,
#: what follows it, and whether it begins its line.
EXTRAS = (4, 2, 4, 3, 2)
BEFORE = 24


def _listed(words: list[str]) -> re.Pattern:
    """Any of the words, whole."""
    return re.compile(r"(?<![^\W\d])(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")s?(?![^\W\d])")


ANNOUNCED = {kind: _listed(words) for kind, words in HINTS.items()}
PERSONAL = _listed([*NAMES, *PLACES])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        # The run of local characters before the sign; what an earlier match took is no part of it. No sign is in it, so
        # the stretches looked at, however they grow, add up to a few times the text.
        span = 64
        while True:
            low = max(end, at - span)
            left = text[low:at].rstrip(LOCAL)
            if left or low == end:
                break
            span *= 4
        start = low + len(left)
        m = DOMAIN.match(text, at + 1)
        if m and start < at:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def valid(kind: int, found: str) -> bool:
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = NOT_DIGIT.sub("", found)
    if kind == CARD:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != PHONE or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; each kind leftmost and non-overlapping, failing matches dropped."""
    out = [(s, EMAIL, e) for s, e in _emails(text)]
    for kind, form in ((IP, IP_FORM), (CARD, CARD_FORM), (PHONE, PHONE_FORM)):
        out += [(m.start(), kind, m.end()) for m in form.finditer(text) if valid(kind, m[0])]
    return sorted(out)


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> list[int]:
    """1 (personal), -1 (not) or 0 (abstains) of each labeler."""
    found = text[start:end]
    near = text[max(0, start - BEFORE) : start].lower()
    pattern = 1 if is_base else 0
    if kind == SECRET:
        classes = (bool(re.search("[0-9]", found)), bool(re.search("[A-Za-z]", found)))
        checksum = 1 if all(classes) and len(set(found)) >= 10 else -1
    elif kind == EMAIL:
        checksum = 1 if re.search(r"[A-Za-z]{2,}$", found) else -1
    elif kind == ID:
        checksum = -1 if found.startswith(("000", "666", "9")) or found[4:6] == "00" or found.endswith("0000") else 1
    else:
        checksum = 1 if valid(kind, found) else -1
    gazetteer = 1 if ANNOUNCED[kind].search(near) else 0
    touching = (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))
    context = -1 if touching else 1 if re.search(r"[=:]\s?[\"']?$", near) else 0
    digits = NOT_DIGIT.sub("", found)
    shape = -1 if digits and len(set(digits)) == 1 else 1 if len(set(found)) >= 6 else 0
    return [pattern, checksum, gazetteer, context, shape]


def extras(text: str, start: int, end: int) -> list[int]:
    """The further features of a candidate, by EXTRAS."""
    found, line = text[start:end], text[max(0, start - BEFORE) : start]
    digits = sum(c.isdigit() for c in found)
    after = text[end : end + 1]
    return [min(3, (end - start) // 12), int(PERSONAL.search(line.lower()) is not None), min(3, 4 * digits // len(found)), 0 if not after or after.isspace() else 1 if not after.isalnum() else 2, int(not line or line.endswith("\n"))]


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover."""
    starts, ends = [], []
    for s, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, code, is_base): base spans, and looser ones that overlap none of them nor one of an earlier
    pattern; code holds the votes and extras."""
    if not SOME.search(text) and "at" not in text:
        return []
    base = base_spans(text)
    out = [(*span, True) for span in base]
    taken = sorted((s, e) for s, _, e in base)
    for kind, form in LOOSE:
        if kind == EMAIL and not ("(at" in text or "[at" in text):
            continue
        starts, ends = disjoint(taken)
        new = []
        for m in form.finditer(text):
            if kind == SECRET and not re.search("[0-9]", m[0]):
                continue
            i = bisect_right(ends, m.start())
            if i == len(ends) or starts[i] >= m.end():
                new.append(m.span())
        out += [(s, kind, e, False) for s, e in new]
        taken = list(merge(taken, new))
    rows = []
    for start, kind, end, is_base in sorted(out):
        code = 0
        for v in votes(text, kind, start, end, is_base):
            code = code * 3 + v + 1
        for value, size in zip(extras(text, start, end), EXTRAS, strict=True):
            code = code * size + value
        rows.append((start, kind, end, code, is_base))
    return rows


def decode(code: int) -> tuple[list[int], list[int]]:
    """The votes and the extras in a code."""
    more, out = [], []
    for size in reversed(EXTRAS):
        more.append(code % size)
        code //= size
    for _ in LABELERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1], more[::-1]


def expectation_maximisation(kinds: np.ndarray, table: np.ndarray, counts: np.ndarray, rounds: int = 50):
    """The chance that each vote pattern is personal, and P(vote | class) of each labeler, by Dawid and Skene's method.
    table: a row of votes (-1, 0, 1) per pattern; priors are by kind. Starts at the majority vote."""
    post = 1 / (1 + np.exp(-table.sum(1).astype(float)))
    likely = np.zeros((2, table.shape[1], 3))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        for v in range(3):
            likely[:, :, v] = w @ (table == v - 1) + 0.5
        likely /= likely.sum(2, keepdims=True)
        log = np.zeros((2, len(counts)))
        for kind in np.unique(kinds):
            own = kinds == kind
            log[:, own] += np.log((w[:, own].sum(1) + 1) / (w[:, own].sum() + 2))[:, None]
        for c, label in product(range(2), range(table.shape[1])):
            log[c] += np.log(likely[c, label, table[:, label] + 1])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return post, likely


def train_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method; returns the weights."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (counts * (p - target)) + ridge * w
        curve = (features * (counts * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One-hot columns of kind, each labeler's vote and each of the extras, with a constant: the extras let the classifier
    tell candidates apart that have the same votes."""
    sizes = [len(KINDS), *[3] * len(LABELERS), *EXTRAS]
    first = 1 + np.cumsum([0, *sizes[:-1]])
    rows = np.zeros((len(codes), 1 + sum(sizes)))
    rows[:, 0] = 1
    for i, (kind, code) in enumerate(zip(kinds.tolist(), codes.tolist(), strict=True)):
        vote, more = decode(code)
        rows[i, first + np.array([kind, *(v + 1 for v in vote), *more])] = 1
    return rows


#: More than any code.
CODES = 100_000


def fit(patterns: list[tuple[int, int, int]]) -> dict[int, float]:
    """The final classifier's chance for each pattern (kind, code, count), by kind * CODES + code."""
    if not patterns:
        return {}
    kinds, codes, counts = (np.array(x) for x in zip(*sorted(patterns), strict=True))
    table = np.array([decode(c)[0] for c in codes.tolist()])
    # EM sees kinds and votes alone
    both, at = np.unique(np.hstack([kinds[:, None], table]), axis=0, return_inverse=True)
    post, _ = expectation_maximisation(both[:, 0], both[:, 1:], np.bincount(at.ravel(), counts, len(both)))
    post = post[at.ravel()]
    x = features(kinds, codes)
    w = train_classifier(x, post, counts.astype(float))
    chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip((kinds * CODES + codes).tolist(), chance.tolist(), strict=True))


def _found(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, base_sha256 string, found array<struct<start:bigint,kind:int,end:bigint,code:int,base:boolean>>"
    item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        names = ("start", "kind", "end", "code", "base")
        for batch in slices(batches, 1):
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                rows = candidates(text)
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _, is_base in rows if is_base)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                spans.append([dict(zip(names, r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(spans, pa.list_(item))], ["doc_id", "base_sha256", "found"])

    return d.mapInArrow(run, schema)


def _patterns(found: DataFrame) -> list[tuple[int, int, int]]:
    """How often each kind and code occurs in all texts; 6 * 3^5 * 192 rows at most (and a few hundred in practice), whatever the corpus."""
    c = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.code").count()
    return [tuple(r) for r in c.collect()]


def pii_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found (array of spans with kind, start, end, base).

    Texts are read once, in Python, into a short row each, which is stored; the labelers' votes on base spans and on
    looser candidates are counted over all texts by pattern, a table of fixed size, on which the driver runs EM and
    trains the classifier. Base spans always stay; other candidates stay if the classifier gives at least `threshold`.
    No text is shuffled. Null texts count as empty; rows are independent, so null or repeated ids need no rule; an empty
    table gives an empty result; other columns are ignored. Places are in code points, ends exclusive.
    """
    found = stored(_found(docs, text_col, id_col), "pii-spans")
    chance = fit(_patterns(found))
    accepted = sorted(k for k, p in chance.items() if p >= threshold)
    spans = F.filter("found", lambda s: s["base"] | (s["kind"] * CODES + s["code"]).isin(accepted))
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in (EMAIL, IP, CARD, PHONE)], "base_sha256", shown.alias("found"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """docs with each span found replaced by its kind in brackets (overlapping spans by the first one's); n_chars, if there, follows.

    The classifier is fitted on one pass over all texts, the text replaced in another; nothing but the pattern counts is
    shuffled. Null texts stay null. All columns of docs stay, whatever their names.
    """
    chance = fit(_patterns(_found(docs, text_col, id_col)))
    accepted = {k for k, p in chance.items() if p >= threshold}
    target = arrow_schema(docs.schema)
    at = docs.columns.index(text_col)
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for s, kind, e, code, is_base in candidates(text):
            if s >= end and (is_base or kind * CODES + code in accepted):
                out += [text[end:s], f"[{KINDS[kind].upper()}]"]
                end = e
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in slices(batches, at):
            columns = [c.cast(f.type) for c, f in zip(batch.columns, target, strict=True)]
            texts = [clean(t) for t in batch.column(at).to_pylist()]
            columns[at] = pa.array(texts, target[at].type)
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], target[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(documents(spark, sf_dir))
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"))
