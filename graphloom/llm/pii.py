"""Personal data: patterns for protected values, and terms that disclose them by co-occurrence.

Protected values are e-mail addresses, IP and card numbers and phone numbers. A term (a word, A-Z
folded) that stands near one value again and again, and seldom elsewhere, tells the
value even where it has been blanked. Over all documents the corpus gives

* the documents in which the term stands within CONTEXT words of the value, and in how many
  different contexts it does (copies of one passage count once),
* the documents that hold the term, and those that hold the value;

the pointwise information log2(p(term, value) / (p(term) p(value))) and the share of
the term's documents that hold the value near it decide. A disclosing term is generalised to a
placeholder, one that discloses almost surely is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashBitmap, Workspace, plain, prepare, returned_names, tidy
from .wordhash import mix, text_chunks, windows, word_bounds, word_hashes

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9][0-9 .-]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words on either side of a value that count as near it.
CONTEXT = 8
#: Disclosing terms up to which their table (16 bytes a row) is broadcast; beyond it it is joined.
BROADCAST_TERMS = 2_000_000

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Disclosure:
    """Thresholds: different contexts, bits of information, shares of a term's documents to generalise or remove it."""

    contexts: int = 3
    bits: float = 6.0
    generalise: float = 0.5
    remove: float = 0.9


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As leftmost matches of local@domain.domain, in linear time: each @ with the run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at] if at - done < 1 << 12 else text[max(done, at - _run_before(text, done, at)) : at]
        run = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if run else None
        if found:
            yield at - run, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)  # an @ is no local character
        at = text.find("@", done)


def _run_before(text: str, low: int, at: int) -> int:
    """How far to look back from an @: in doubling steps, to the beginning of the local run at least."""
    step = 64
    while step < at - low and len((part := text[at - step : at]).rstrip(LOCAL)) == 0 and part:
        step *= 2
    return min(step, at - low)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) in code points, by kind as in KINDS, then start; of a kind they do not overlap. A match that fails its check is dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    ips, cards = [], []
    for run in NUMBERS.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
                ips.append(("ip", *m.span()))
        if b - a >= 16:
            for m in CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    cards.append(("card", *m.span()))
    out += ips + cards
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _values(text: str, spans: list[Span]) -> list[int]:
    """A 63-bit number of each protected value; spelling does not count."""
    out = []
    for kind, a, b in spans:
        value = text[a:b].lower() if kind in ("email", "ip") else "".join(c for c in text[a:b] if c.isdigit())
        out.append(int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little") >> 1)
    return out


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, the texts' offsets, words' starts, ends and hashes) for each chunk; texts' words by searchsorted."""
    for first, data, limits in text_chunks(column):
        starts, ends, _ = word_bounds(data, limits)
        yield first, data, limits, starts, ends, word_hashes(data, starts, ends, True)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, one more than there are bytes."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def near_values(docs: DataFrame) -> DataFrame:
    """(value, term, context, doc): each term near each protected value, once for a document; doc is the text's hash with its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for first, data, limits, starts, ends, hashes in _words(batch.column(0)):
                for i in range(len(limits) - 1):
                    text = data[limits[i] : limits[i + 1]].tobytes().decode()
                    spans = base_spans(text)
                    if not spans:
                        continue
                    lo, hi = np.searchsorted(starts, limits[i : i + 2])
                    points = _points(data[limits[i] : limits[i + 1]])
                    begin, end = points[starts[lo:hi] - limits[i]], points[ends[lo:hi] - limits[i]]
                    terms, inside = hashes[lo:hi], np.zeros(hi - lo, bool)
                    places = []
                    for _, a, b in spans:
                        x, y = np.searchsorted(end, a, "right"), np.searchsorted(begin, b)
                        inside[x:y] = True
                        places.append((x, y))
                    for value, (x, y) in zip(_values(text, spans), places, strict=True):
                        near = np.concatenate([np.arange(max(0, x - CONTEXT), x), np.arange(y, min(hi - lo, y + CONTEXT))])
                        near = near[~inside[near]]
                        if not len(near):
                            continue
                        context = mix(windows(terms[near], len(near)))[0]
                        found = np.unique(terms[near])
                        for column, x_ in zip(out, (np.full(len(found), value, np.int64), found.view(np.int64), np.full(len(found), context, np.uint64).view(np.int64), np.full(len(found), keys[first + i], np.int64)), strict=True):
                            column.append(x_)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["value", "term", "context", "doc"])

    return docs.select("text", F.xxhash64("doc_id", "text").alias("doc")).mapInArrow(tidy(run), "value long, term long, context long, doc long").distinct()


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, docs): how many rows hold each of the terms, over all documents."""
    wanted = HashBitmap(terms, F.col("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, limits, starts, _, hashes in _words(batch.column(0)):
                hit = np.flatnonzero(wanted.test(hashes))
                owner = np.searchsorted(limits, starts[hit], "right")
                found.append(np.unique(np.stack([owner, hashes[hit].view(np.int64)]), axis=1)[1])
            if found:
                term, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "docs"])

    return docs.select("text").mapInArrow(tidy(run), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def disclosing_terms(docs: DataFrame, work: Workspace, rule: Disclosure = Disclosure()) -> DataFrame:
    """(term, share): terms whose information on some value exceeds the thresholds; share: the greatest share of the term's documents with one value near it."""
    near = work.write(near_values(docs), "near")
    pairs = near.groupBy("value", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("doc").alias("both")).filter(F.col("contexts") >= rule.contexts)
    pairs = work.write(pairs, "pairs")
    if pairs.isEmpty():
        return work.write(pairs.select("term", F.lit(0.0).alias("share")), "terms")
    values = near.select("value", "doc").distinct().groupBy("value").agg(F.count("*").alias("holders"))
    terms = term_documents(docs, pairs.select("term").distinct())
    total = docs.count()
    bits = F.log2(F.col("both") * F.lit(float(total)) / (F.col("docs") * F.col("holders")))
    share = F.least(F.lit(1.0), F.col("both") / F.col("docs"))
    told = pairs.join(values, "value").join(terms, "term").filter((bits >= rule.bits) & (share >= rule.generalise))
    return work.write(told.groupBy("term").agg(F.max(share).alias("share")), "terms")


def find_personal_data(docs: DataFrame, columns: list[str] | None = None, rule: Disclosure = Disclosure(), texts: bool = True) -> DataFrame:
    """Each row of docs (doc_id, text) with its personal data.

    Returns doc_id, the named columns, n_email, n_ip, n_card, n_phone, base (base spans, kind:start:end joined by
    commas, by kind and start), spans (with term spans after them; those that touch a base span are left out) and, with
    texts, sanitised: the text with base spans and generalised terms as placeholders, and without removed terms. Null text counts as empty
    (sanitised stays null); null and repeated ids and repeated rows are handled row by row, though equal rows count once in the statistics.
    A named column that has a result column's name is returned with _input after it.
    """
    asked = [c for c in columns or [] if c not in ("doc_id", "text")]
    names = [f"c{i}" for i in range(len(asked))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(plain(c).alias(n) for c, n in zip(asked, names, strict=True)))
    spark = prepare(docs.sparkSession)
    work = Workspace(spark, "pii")
    told = disclosing_terms(docs.select("doc_id", "text"), work, rule)
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in names]
    out_names = ["doc_id", *names, "n_email", "n_ip", "n_card", "n_phone", "base", "spans", *(["sanitised"] * texts)]
    schema = ", ".join(["doc_id long", *fields, *(f"n_{k} long" for k in KINDS), "base string", "spans string", *(["sanitised string"] * texts)])
    results = out_names[1 + len(names) :]
    returned = ["doc_id", *returned_names(asked, ["doc_id", *results]), *results]
    n = 2 + len(names)

    def finish(batch: pa.RecordBatch, term_spans: Callable[[int], list[tuple[int, int, float]]]) -> pa.RecordBatch:
        rows = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            base = base_spans(text or "")
            terms = _apart(term_spans(i), base)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            every = ",".join(x for x in (shown, ",".join(f"term:{a}:{b}" for a, b, _ in terms)) if x)
            rows.append((*counts, shown, every, sanitise(text, base, terms, rule) if texts else None))
        made = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        arrays = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)][: 6 + texts]
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:n], *arrays], out_names)

    if (count := told.count()) <= BROADCAST_TERMS:
        table_ = told.toArrow()
        order = np.argsort(table_.column("term").to_numpy())
        shared = spark.sparkContext.broadcast((table_.column("term").to_numpy()[order], table_.column("share").to_numpy()[order]))

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, share = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found: dict[int, list[tuple[int, int, float]]] = {}
                    if len(terms):
                        for row, a, b, h in _located(part.column(1), lambda x: terms[np.minimum(np.searchsorted(terms, x), len(terms) - 1)] == x):
                            found.setdefault(row, []).append((a, b, float(share[np.searchsorted(terms, h)])))
                    yield finish(part, lambda i, found=found: found.get(i, []))

        return docs.mapInArrow(tidy(direct), schema).toDF(*returned)

    # too many terms to broadcast: candidate words go to the terms' partitions, and what is found goes back to the rows
    test = HashBitmap(told, F.col("term"))
    numbered = work.write(docs.withColumn("\x00row", F.monotonically_increasing_id()), f"rows-{count}")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            found = [(int(keys[r]), h, a, b) for r, a, b, h in _located(batch.column(0), lambda x: test.test(x.view(np.uint64)))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["row", "term", "a", "b"])

    words = numbered.select("text", F.col("\x00row").alias("row")).mapInArrow(tidy(candidates), "row long, term long, a long, b long")
    words = words.join(told, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b", "share"))).alias("\x00terms"))
    joined = numbered.join(words.withColumnRenamed("row", "\x00row"), "\x00row", "left").select("doc_id", "text", *names, "\x00terms")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(n).to_pylist()
            yield finish(batch, lambda i, terms=terms: [(t["a"], t["b"], t["share"]) for t in terms[i] or []])

    return joined.mapInArrow(tidy(merged), schema).toDF(*returned)


def _located(column: pa.Array, test: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, end, term) of the words that pass a test of their hashes (as signed), in code points."""
    for first, data, limits, starts, ends, hashes in _words(column):
        signed = hashes.view(np.int64)
        hit = np.flatnonzero(test(signed)) if len(signed) else []
        points: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        for w in hit:
            i = int(np.searchsorted(limits, starts[w], "right")) - 1
            if points[0] != i:
                points = (i, _points(data[limits[i] : limits[i + 1]]))
            yield first + i, int(points[1][starts[w] - limits[i]]), int(points[1][ends[w] - limits[i]]), int(signed[w])


def _apart(terms: list[tuple[int, int, float]], base: list[Span]) -> list[tuple[int, int, float]]:
    """The term spans that touch no base span."""
    if not terms or not base:
        return terms
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken])
    at = np.searchsorted(starts, [b for _, b, _ in terms]) - 1  # the last base span that begins before the term's end
    return [t for t, i in zip(terms, at, strict=True) if i < 0 or reach[i] <= t[0]]


def sanitise(text: str | None, base: list[Span], terms: list[tuple[int, int, float]], rule: Disclosure) -> str | None:
    """The text with placeholders: [EMAIL] and so on (of overlapping base spans the longest that begins first), [TERM]; removed terms leave nothing."""
    if text is None or not base and not terms:
        return text
    marks = [(a, -b, f"[{k.upper()}]") for k, a, b in base] + [(a, -b, "" if share >= rule.remove else "[TERM]") for a, b, share in terms]
    out, done = [], 0
    for a, negative, mark in sorted(marks):
        b = -negative
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
