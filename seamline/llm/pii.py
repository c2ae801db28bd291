"""Personal data: base patterns, and terms that reveal a protected entity by their co-occurrence with it in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import ALNUM, BitFilter, apart, bit_filter, chunks, discard, flat_texts, stored, word_hashes, word_spans

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is looked at from its begin alone: what fails there fails inside.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Distinct texts in which a term has to occur with an entity.
SUPPORT = 3
#: A term reveals an entity if their pointwise mutual information is at least this part of the entity's own information.
DISCLOSURE = 0.9
#: From this part on a revealing term is removed, below it is generalised.
REMOVE = 0.97


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, from each @ outwards: the local part is the whole run of its characters before the @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and not overlapping within the kind; a match that fails its test is dropped."""
    found = {k: [] for k in KINDS}
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)


def entity(kind: str, value: str) -> int:
    """One number for all ways to write an entity."""
    return _hash(f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}")


def words_outside(data: np.ndarray, bounds: np.ndarray, spans: list[list[tuple[str, int, int]]], bits: BitFilter | None = None) -> tuple[np.ndarray, ...]:
    """Row, term, start and end, in characters, of the words of two characters and more that lie outside all base spans of their row; with bits, of those that pass the filter."""
    starts, ends, first = word_spans(data, bounds, ALNUM)
    terms = word_hashes(data, starts, ends).view(np.int64)
    at = np.arange(len(terms)) if bits is None else np.flatnonzero(bits.has(terms))
    row = np.searchsorted(first, at, "right") - 1
    before = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    start, end = before[starts[at]] - before[bounds[row]], before[ends[at]] - before[bounds[row]]
    keep = end - start > 1
    for r in np.unique(row):
        if spans[r]:
            a, b = np.searchsorted(row, [r, r + 1])
            begins, stops = np.array(sorted((x, y) for _, x, y in spans[r])).T
            stops = np.concatenate([[0], np.maximum.accumulate(stops)])
            keep[a:b] &= stops[np.searchsorted(begins, end[a:b])] <= start[a:b]
    return row[keep], terms[at][keep], start[keep], end[keep]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
FOUND = "doc_id long, key binary, spans array<struct<kind:string,start:int,end:int>>, entities array<long>, terms array<long>"


def _with_spans(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[list[tuple[str, int, int]]], list[bytes]]]:
    """Parts of a batch, with each row's text, base spans and text digest. Rows without @ and digits aren't searched."""
    for rows, data, bounds in chunks(batch):
        special = np.cumsum(np.concatenate([[0], (data == 0x40) | ((data >= 0x30) & (data <= 0x39))]))
        hot = special[bounds[1:]] > special[bounds[:-1]]
        column = rows.column(rows.schema.get_field_index("text"))
        raw = data.tobytes()
        spans, keys = [], []
        for r in range(rows.num_rows):
            part = raw[bounds[r] : bounds[r + 1]]
            keys.append(hashlib.md5(part).digest())
            spans.append([(k, a, b) for k, found in base_spans(part.decode()).items() for a, b in found] if hot[r] else [])
        yield rows, column, spans, keys


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts, spans, keys in _with_spans(batch):
            terms = [[] for _ in spans]
            if some := [r for r, s in enumerate(spans) if s]:
                row, term, *_ = words_outside(*flat_texts(texts.take(pa.array(some))), [spans[r] for r in some])
                for r, words in zip(some, np.split(term, np.searchsorted(row, np.arange(1, len(some)))), strict=True):
                    terms[r] = np.unique(words)
            entities = [sorted({entity(k, texts[r].as_py()[a:b]) for k, a, b in s}) for r, s in enumerate(spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], pa.list_(SPAN)),
                    pa.array(entities, pa.list_(pa.int64())),
                    pa.array(terms, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "spans", "entities", "terms"],
            )


def occurrences(batches: Iterator[pa.RecordBatch], bits: BitFilter) -> Iterator[pa.RecordBatch]:
    """(t, key) for each distinct word of a text that passes the filter."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            starts, ends, first = word_spans(data, bounds, ALNUM)
            terms = word_hashes(data, starts, ends).view(np.int64)
            hit = np.flatnonzero(bits.has(terms))
            row = np.searchsorted(first, hit, "right") - 1
            pairs = np.unique(np.stack([row, terms[hit]], 1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
            raw = data.tobytes()
            keys = {int(r): hashlib.md5(raw[bounds[r] : bounds[r + 1]]).digest() for r in np.unique(pairs[:, 0])}
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1], pa.int64()), pa.array([keys[int(r)] for r in pairs[:, 0]], pa.binary())], names=["t", "key"])


def revealing(documents: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(e, t, part) of terms that reveal an entity.

    All counts are of distinct texts of the whole corpus. With n texts, of which d(e) hold the
    entity, d(t) the term anywhere and c(e, t) both, the term outside base spans, the pointwise mutual
    information is log2(n c / (d(e) d(t))) and the entity's own information log2(n / d(e)); part is
    their ratio. It is 1 if the term occurs together with the entity alone.
    """
    texts = stored(found.where(F.size("entities") > 0).groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "texts")
    n = found.select("key").distinct().count()
    held = texts.select("key", F.explode("entities").alias("e"))
    per_entity = held.groupBy("e").agg(F.count(F.lit(1)).alias("d_e")).where(F.col("d_e") >= support)
    both = held.join(per_entity.select("e"), "e", "left_semi").join(texts.select("key", "terms"), "key").select("e", F.explode("terms").alias("t"))
    pairs = both.groupBy("e", "t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= support).join(per_entity, "e")
    own = F.log2(F.lit(float(max(n, 1))) / F.col("d_e"))

    def part(d_t: str):
        return F.when(own > 0, (F.log2(F.lit(float(max(n, 1))) * F.col("c") / (F.col("d_e") * F.col(d_t)))) / own).otherwise(0.0)

    # a term occurs in no fewer texts than those that hold some entity as well
    at_least = texts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("least_d_t"))
    possible = stored(pairs.join(at_least, "t").where(part("least_d_t") >= disclosure).drop("least_d_t"), "possible")
    terms = possible.select("t").distinct()
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(terms, F.col("t")))
    seen = documents.select("text").mapInArrow(lambda b: occurrences(b, shared.value), "t long, key binary")
    per_term = seen.join(terms, "t", "left_semi").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("d_t"))
    out = stored(possible.join(per_term, "t").select("e", "t", part("d_t").alias("part")).where(F.col("part") >= disclosure), "revealing")
    discard(texts, possible)
    return out


def places(batches: Iterator[pa.RecordBatch], bits: BitFilter, everywhere: bool) -> Iterator[pa.RecordBatch]:
    """(key, t, start, end) of the words outside base spans that pass the filter, in texts with base spans or everywhere."""
    for batch in batches:
        for _, data, bounds in chunks(batch):
            starts, ends, first = word_spans(data, bounds, ALNUM)
            hit = np.flatnonzero(bits.has(word_hashes(data, starts, ends).view(np.int64)))
            some = np.unique(np.searchsorted(first, hit, "right") - 1)
            raw = data.tobytes()
            parts = [raw[bounds[r] : bounds[r + 1]] for r in some]
            spans = [[(k, a, b) for k, found in base_spans(p.decode()).items() for a, b in found] for p in parts]
            if not everywhere:
                parts, spans = [p for p, s in zip(parts, spans, strict=True) if s], [s for s in spans if s]
            row, term, start, end = words_outside(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), spans, bits)
            keys = [hashlib.md5(p).digest() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r in row], pa.binary()), pa.array(term, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["key", "t", "start", "end"])


def term_spans(documents: DataFrame, reveals: DataFrame, everywhere: bool) -> DataFrame:
    """(key, terms): by text digest, the spans of all occurrences of terms that reveal some entity; `part` is the largest of a term."""
    worst = reveals.groupBy("t").agg(F.max("part").alias("part"))
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(worst, F.col("t")))
    found = documents.select("text").mapInArrow(lambda b: places(b, shared.value, everywhere), "key binary, t long, start int, end int")
    spans = found.join(worst, "t").groupBy("key", "start", "end").agg(F.max("part").alias("part"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "part"))).alias("terms"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(documents: DataFrame, everywhere: bool = False) -> DataFrame:
    """Per document: counts of base spans by kind, digest of the base spans, and all spans with those of revealing terms.

    Terms are marked wherever they stand in texts with base spans; with `everywhere`, in all texts.
    Null and empty texts have no spans. Repeated rows and rows of one doc_id keep a row each. Counts
    behind the terms are of distinct texts, so copies don't make a term reveal anything.
    """
    found = stored(documents.select("doc_id", "text").mapInArrow(find, FOUND), "found")
    terms = term_spans(documents, revealing(documents, found), everywhere)
    rows = found.drop("terms").join(terms, "key", "left")
    n = {k: _count_of(k).alias(f"n_{k}") for k in KINDS}
    term = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,part:double>>")), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", *n.values(), F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", term)).alias("spans"))


def kind_of(term: str) -> str:
    """What a term is, one step up: a number, a code of letters and digits, or a word."""
    digits = sum(c.isdigit() for c in term)
    return "[NUMBER]" if digits == len(term) else "[CODE]" if digits else "[TERM]"


def sanitised(text: str, spans: list[tuple[str, int, int]], terms: list[dict]) -> str:
    """Base spans by the name of their kind, revealing terms generalised to [TERM] or removed. Overlapping base spans become one."""
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in spans] + [(t["start"], t["end"], "" if t["part"] >= REMOVE else kind_of(text[t["start"] : t["end"]])) for t in terms]
    out, at = [], 0
    for a, b, name in sorted(cuts):
        if a >= at:
            out += [text[at:a], name]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _sanitise(batches: Iterator[pa.RecordBatch], bits: BitFilter | None) -> Iterator[pa.RecordBatch]:
    """Without bits: rows come with their terms. With bits: rows that pass the filter are left out, the others have no terms."""
    for batch in batches:
        for rows, texts, spans, keys in _with_spans(batch):
            keep = [i for i, name in enumerate(rows.schema.names) if name not in ("__key", "__terms")]
            terms = rows.column(rows.schema.get_field_index("__terms")).to_pylist() if bits is None else [None] * rows.num_rows
            new = [sanitised(texts[r].as_py(), s, terms[r] or []) if s or terms[r] else texts[r].as_py() for r, s in enumerate(spans)]
            out = pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if rows.schema.names[i] == "text" else rows.column(i) for i in keep], names=[rows.schema.names[i] for i in keep])
            yield out if bits is None else out.filter(pa.array(~bits.has(_numbers(keys))))


def _numbers(keys: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(k[:4], "big") for k in keys], np.int64)


def _passing(batches: Iterator[pa.RecordBatch], bits: BitFilter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            raw = data.tobytes()
            keys = [hashlib.md5(raw[bounds[r] : bounds[r + 1]]).digest() for r in range(rows.num_rows)]
            mask = pa.array(bits.has(_numbers(keys)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.binary())], names=[*rows.schema.names, "__key"]).filter(mask)


@apart
def sanitise(documents: DataFrame, everywhere: bool = False) -> DataFrame:
    """The same rows and columns, with personal data and the terms that reveal it taken out of the texts.

    Terms are taken out wherever they stand in texts with base spans; with `everywhere`, from all texts.
    Only documents that may hold such terms are joined with them; all others are rewritten in place.
    Null and empty texts stay; repeated rows have a row each and are rewritten alike; an empty table
    stays empty. A term that is generalised becomes the name of what it is: [NUMBER] if it is one,
    [CODE] if letters and digits are mixed, else [TERM].
    """
    found = stored(documents.select("doc_id", "text").mapInArrow(find, FOUND), "found")
    reveals = revealing(documents, found)
    terms = stored(term_spans(documents, reveals, everywhere), "terms")
    discard(found, reveals)
    prefix = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(terms, prefix))
    plain = documents.mapInArrow(lambda b: _sanitise(b, shared.value), documents.schema)
    columns = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes)
    some = documents.mapInArrow(lambda b: _passing(b, shared.value), f"{columns}, __key binary")
    some = some.join(terms.select(F.col("key").alias("__key"), F.col("terms").alias("__terms")), "__key", "left").select(*[f"`{n}`" for n in documents.columns], "__terms")
    return plain.unionAll(some.mapInArrow(lambda b: _sanitise(b, None), documents.schema))
