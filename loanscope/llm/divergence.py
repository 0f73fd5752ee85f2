"""Source divergence audit by chunk factorisation: how far each source's words stray from others of its language.

Tasks count the whitespace chunks of their documents, one row for each language
and chunk, with the occurrences by source and, where fewer than ``least_docs``
documents hold it, their numbers.  Rows are dealt out and sorted by chunk; each
distinct chunk meets its tokeniser once, where its rows pass in a run, and its
terms take over the rows' counts.  A second exchange brings the rows of a term
together: occurrences add up, and the numbers tell exactly whether a term is in
``least_docs`` distinct documents (a chunk in as many alone suffices; of one in
fewer all numbers are there).

Kept terms get integer shares p = 1 + floor(SCALE * (count + 1) / (N + V)) in
every group; f(p, q) = floor((p - q)^2 / q).  The sum of f over all kept terms of
two sources needs no pair of a source and a term it lacks: the terms that both
hold are compared one by one, those that one holds are counted by their share
against the other's share of an absent term, and all others have one value.

Documents are rows: rows that share an id or are repeated count one by one.
Defined cases: null text, language and source are empty strings; a text without
terms leaves its group in the result with absent terms only; a language without
kept terms has pairs of value 0 and no term rows; equal values rank by item; a
very long text is counted whole, by itself; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.llm.shared import chunks as sliced
from loanscope.llm.shared import stored

#: Shares are counted in this part.
SCALE = 1_000_000_000
# Text bytes whose counts a task holds at once, and whose words it holds.
TEXT_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
# Rows of counts, and of compared pairs, that a task holds at once.
ROWS_AT_ONCE = 400_000
PAIRS_AT_ONCE = 2_000_000
# Pairs of a document and a chunk that become rows of counts at once.
COUNTS_AT_ONCE = 250_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTED = pa.schema([("lang", pa.string()), ("item", pa.binary()), ("sources", pa.string()), ("numbers", pa.list_(pa.int64()))])
#: Sources are one string; ``numbers`` are the occurrences by source, then documents (none: enough of them).
COUNTED = "lang string, item binary, sources string, numbers array<bigint>"
_BETWEEN = "\0"


def _packed(name: str) -> str:
    return name.replace("\1", "\1\2").replace("\0", "\1\3")


def _unpacked(name: str) -> str:
    return name.replace("\1\3", "\0").replace("\1\2", "\1")


def terms_of(chunk: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    return _TERM.findall(chunk.lower())                    # bytes.lower changes A-Z only


def _counted(langs: pa.Array, items: pa.Array, names: pa.Array, key: np.ndarray, source: np.ndarray, n: np.ndarray,
             doc_key: np.ndarray, doc: np.ndarray, least_docs: int) -> pa.RecordBatch:
    """One row for each key (a row of langs and items): occurrences by source, and its documents if they are fewer than ``least_docs``.

    ``key``, ``source``, ``n`` are occurrences; ``doc_key``, ``doc`` the documents, both in any order and repeated.
    """
    rows = len(items)
    at = np.lexsort((source, key))
    key, source, n = key[at], source[at], n[at]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (source[1:] != source[:-1])][:len(key)])
    key, source = key[first], source[first]
    n = np.add.reduceat(n, first) if len(first) else n
    at = np.lexsort((doc, doc_key))
    doc_key, doc = doc_key[at], doc[at]
    new = np.r_[True, (doc_key[1:] != doc_key[:-1]) | (doc[1:] != doc[:-1])][:len(doc)]
    doc_key, doc = doc_key[new], doc[new]
    few = np.bincount(doc_key, minlength=rows)[doc_key] < least_docs
    doc_key, doc = doc_key[few], doc[few]
    of_source, of_doc = np.bincount(key, minlength=rows), np.bincount(doc_key, minlength=rows)
    ends = np.cumsum(of_source + of_doc)
    starts = ends - of_source - of_doc
    numbers = np.empty(len(key) + len(doc_key), np.int64)
    numbers[starts[key] + _rank(key, of_source)] = n
    numbers[(starts + of_source)[doc_key] + _rank(doc_key, of_doc)] = doc
    cuts = pa.array(np.concatenate([[0], np.cumsum(of_source)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        langs, items, pc.binary_join(pa.ListArray.from_arrays(cuts, names.take(pa.array(source))), _BETWEEN),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(numbers))], schema=_COUNTED)


def _rank(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its key; keys are sorted."""
    return np.arange(len(key)) - (np.cumsum(sizes) - sizes)[key]


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _count_chunks(least_docs: int):
    """Arrow batches (text, lang, source, number) to counts of the white-space chunks.

    Words are held for a piece of the texts, then only (document, chunk, occurrences) in 32 bits each, and
    rows of counts are made for some chunks at a time.
    """
    def piece_pairs(text: pa.Array):
        """(document, chunk, occurrences) of each distinct pair, and the chunks."""
        words = pc.ascii_split_whitespace(text)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        found = words.flatten().cast(pa.binary()).dictionary_encode()
        names, width = found.dictionary, max(len(found.dictionary), 1)
        pair = np.repeat(np.arange(len(sizes), dtype=np.int64) * width, sizes)
        pair += found.indices.to_numpy(zero_copy_only=False)
        del words, found
        pair.sort()
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][:len(pair)])
        doc, chunk = np.divmod(pair[first], width)
        n = np.diff(np.r_[first, len(pair)])
        blank = pc.equal(names, b"").to_numpy(zero_copy_only=False)
        there = ~blank[chunk]
        return doc[there], chunk[there], n[there], names

    def pairs(batch: pa.RecordBatch):
        """The same, of all texts of the batch."""
        docs, codes, times, names = [], [], [], []
        rows = 0
        for piece in sliced([batch], "text", PIECE_BYTES):
            doc, chunk, n, found = piece_pairs(piece.column(0))
            docs.append((doc + rows).astype(np.int32))
            codes.append(chunk.astype(np.int32))
            times.append(n.astype(np.int32))
            names.append(found)
            rows += piece.num_rows
        common = pa.chunked_array(names, pa.binary()).dictionary_encode()   # one dictionary for all pieces
        codes = [part.indices.to_numpy(zero_copy_only=False)[code] for part, code in zip(common.chunks, codes)]
        return np.concatenate(docs), np.concatenate(codes), np.concatenate(times), common.chunk(0).dictionary

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, chunk, n, chunks = pairs(batch)
        lang, langs = _codes(batch.column(1))
        source, sources = _codes(batch.column(2))
        sources = pa.array([_packed(name) for name in sources.to_pylist()], pa.string())
        number = batch.column(3).to_numpy(zero_copy_only=False)
        order = chunk.astype(np.int64) << 32                                # pairs by chunk: chunk and place in one number
        order |= np.arange(len(chunk))
        del chunk
        order.sort()
        at = 0
        while at < len(order):
            last = order[min(at + COUNTS_AT_ONCE, len(order)) - 1] >> 32
            stop = int(np.searchsorted(order, (last + 1) << 32))
            place = order[at:stop] & 0xFFFFFFFF
            of = doc[place]
            keys, key = np.unique(lang[of] * len(chunks) + (order[at:stop] >> 32), return_inverse=True)
            of_lang, of_chunk = np.divmod(keys, len(chunks))
            yield _counted(langs.take(pa.array(of_lang)), chunks.take(pa.array(of_chunk)), sources, key, source[of], n[place].astype(np.int64),
                           key, number[of], least_docs)
            at = stop

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = 0
        for batch in batches:
            for part in sliced([batch], "text", TEXT_BYTES):
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(0))).as_py() or 0
                rows += part.num_rows
                if size >= TEXT_BYTES or rows >= ROWS_AT_ONCE:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size, rows = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches):
        for batch in parts(batches):
            for made in count(batch):
                for at in range(0, made.num_rows, 20_000):
                    yield made.slice(at, 20_000)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of many rows, sorted as the input, that no run of equal keys is torn apart by."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def key(batch, at):
        return [batch.column(batch.schema.get_field_index(k))[at].as_py() for k in keys]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS_AT_ONCE or key(held[0], 0) == key(batch, batch.num_rows - 1):
            continue
        whole = joined()
        last, low, high = key(whole, rows - 1), 0, rows - 1
        while low < high:                                                   # first row of the last run
            mid = (low + high) // 2
            low, high = (low, mid) if key(whole, mid) == last else (mid + 1, high)
        held, rows = [whole.slice(low)], rows - low
        if low:
            yield whole.slice(0, low)
    if rows:
        held = [joined()]                                                   # what was joined is held once
        yield held[0]


def _parts(batch: pa.RecordBatch, least_docs: int):
    """(row, source, count) of each occurrence count and (row, document) of each document of a batch of counts.

    The numbers -1, -2, ... stand for the documents of a row that has enough of them.
    """
    sources = pc.split_pattern(batch.column(2), _BETWEEN)
    size, both = (pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (sources, batch.column(3)))
    row = np.repeat(np.arange(batch.num_rows), both)
    counts = _rank(row, both) < size[row]
    numbers = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    enough = np.repeat(np.flatnonzero(both == size), least_docs)
    made = -1 - np.arange(len(enough)) % least_docs
    return row[counts], sources.flatten(), numbers[counts], np.r_[row[~counts], enough], np.r_[numbers[~counts], made]


def _spread(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """For entries owned by rows, each entry repeated for the ``sizes`` slots of its row: (entry, slot)."""
    times = sizes[owner]
    entry = np.repeat(np.arange(len(owner)), times)
    return entry, starts[owner][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)


def _tokenise(least_docs: int):
    """Counts of chunks, sorted by chunk, to counts of their terms: each distinct chunk is tokenised once."""
    def run(batches):
        for batch in _runs(batches, ["item"]):
            chunk, distinct = _codes(batch.column(1))
            found: list[bytes] = []
            ends = [0]
            for at in range(0, len(distinct), 20_000):
                for item in distinct.slice(at, 20_000).to_pylist():
                    found += terms_of(item)
                    ends.append(len(found))
            starts = np.array(ends[:-1], np.int64)
            sizes = np.diff(np.array(ends, np.int64))
            term, terms = _codes(pa.array(found, pa.binary()))
            del found, ends, distinct
            if not len(terms):
                continue
            lang, langs = _codes(batch.column(0))
            row, names, n, doc_row, doc = _parts(batch, least_docs)
            source, names = _codes(names)
            entry, slot = _spread(chunk[row], starts, sizes)
            keys, key = np.unique(lang[row][entry] * len(terms) + term[slot], return_inverse=True)
            source, n = source[entry], n[entry]
            del row, entry, slot
            entry, slot = _spread(chunk[doc_row], starts, sizes)
            doc_key = np.searchsorted(keys, lang[doc_row][entry] * len(terms) + term[slot])
            doc = doc[entry]
            del doc_row, entry, slot, chunk, lang
            of_lang, of_term = np.divmod(keys, len(terms))
            made = _counted(langs.take(pa.array(of_lang)), terms.take(pa.array(of_term)), names, key, source, n, doc_key, doc, least_docs)
            for at in range(0, made.num_rows, 20_000):
                yield made.slice(at, 20_000)

    return run


def _sum_terms(least_docs: int):
    """Counts of terms, sorted by language and term, to rows (lang, term, number, lang_n, source, n, first) for each source
    that has a kept term: a number for the term, its occurrences in the language and in the source, whether it is the term's first row."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("number", pa.int64()), ("lang_n", pa.int64()),
                        ("source", pa.string()), ("n", pa.int64()), ("first", pa.bool_())])

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in _runs(batches, ["lang", "item"]):
            item, items = _codes(batch.column(1))
            lang, langs = _codes(batch.column(0))
            keys, key = np.unique(lang * len(items) + item, return_inverse=True)
            of_lang, of_item = np.divmod(keys, len(items))
            row, names, n, doc_row, doc = _parts(batch, least_docs)
            source, names = _codes(names)
            made = _counted(langs.take(pa.array(of_lang)), items.take(pa.array(of_item)), names, key[row], source, n,
                            key[doc_row], doc, least_docs)
            kept = made.filter(pc.equal(pc.list_value_length(pc.split_pattern(made.column(2), _BETWEEN)), pc.list_value_length(made.column(3))))
            row, names, n, _, _ = _parts(kept, least_docs)
            source, names = _codes(names)
            source = pa.array([_unpacked(name) for name in names.to_pylist()], pa.string()).take(pa.array(source))
            at = pa.array(row)
            total = np.zeros(kept.num_rows, np.int64)
            np.add.at(total, row, n)
            yield pa.RecordBatch.from_arrays([kept.column(0).take(at), kept.column(1).cast(pa.string()).take(at), pa.array(row + number),
                                              pa.array(total[row]), source, pa.array(n, pa.int64()),
                                              pa.array(np.r_[True, row[1:] != row[:-1]][:len(row)])], schema=schema)
            number += kept.num_rows

    return run


def term_counts(docs: DataFrame, *, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """(lang, term, number, lang_n, source, n, first): occurrences of the terms in at least ``least_docs`` documents of their
    language, in the language and in each source that has them; ``number`` stands for language and term, ``first`` marks one
    row of each.  To be stored before the numbers are used."""
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    base = docs.select(plain(text_col).alias("text"), plain(lang_col).alias("lang"), plain(source_col).alias("source"),
                       F.monotonically_increasing_id().alias("number"))
    # Written once: document numbers stay the same whatever is computed again.
    counted = stored(base.mapInArrow(_count_chunks(least_docs), COUNTED), "chunk-counts")
    terms = (counted.repartition("item").sortWithinPartitions("item").mapInArrow(_tokenise(least_docs), COUNTED))
    return (terms.repartition("lang", "item").sortWithinPartitions("lang", "item")
            .mapInArrow(_sum_terms(least_docs), "lang string, term string, number bigint, lang_n bigint, source string, n bigint, first boolean"))


def _share(count: Column, total: Column, vocabulary: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + vocabulary)), in whole numbers of 38 digits."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(18,0)")
    bottom = total.cast("decimal(20,0)") + vocabulary.cast("decimal(18,0)")
    return F.when(bottom > 0, 1 + F.call_function("div", top, bottom))


def _stray(p: Column, q: Column) -> Column:
    gap = (p - q).cast("decimal(18,0)")
    return F.call_function("div", gap * gap, q.cast("decimal(18,0)"))


def _shared_terms():
    """Rows (number, lang, source, p, absent), sorted by number, to (lang, source, item, more).

    For two sources that hold a term, ``more`` is what comparing their shares adds to the sums that count it as
    held by one of them alone: f(p, q) - f(p, absent q) - f(absent p, q) + f(absent p, absent q).
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("more", pa.int64())])

    def f(p, q):
        return (p - q) ** 2 // q

    def run(batches):
        for batch in _runs(batches, ["number"]):
            row, _ = _codes(batch.column(0))
            source, names = _codes(batch.column(2))
            lang, langs = _codes(batch.column(1))
            p, absent = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            sizes = np.bincount(row)
            starts = np.cumsum(sizes) - sizes
            ends = np.cumsum(sizes[row])
            at = 0
            while at < len(row):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                a, b = _spread(row[at:stop], starts, sizes)
                a, at = a + at, stop
                other = a != b
                a, b = a[other], b[other]
                more = f(p[a], p[b]) - f(p[a], absent[b]) - f(absent[a], p[b]) + f(absent[a], absent[b])
                code = (lang[a] * len(names) + source[a]) * len(names) + source[b]
                order = np.argsort(code, kind="stable")
                code, more = code[order], more[order]
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][:len(code)])
                if not len(first):
                    continue
                of, item = np.divmod(code[first], len(names))
                of_lang, of_source = np.divmod(of, len(names))
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(of_lang)), names.take(pa.array(of_source)), names.take(pa.array(item)),
                     pa.array(np.add.reduceat(more, first))], schema=schema)

    return run


def audit(docs: DataFrame, *, least_docs: int = 3, top: int = 200, scale: int = SCALE, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their
    divergence, part ``term`` the ``top`` terms that the source has more of than its language."""
    counts = stored(term_counts(docs, least_docs=least_docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "term-counts")
    groups = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    zero = F.lit(0).cast("bigint")
    langs = counts.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    made = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "held", "v", "lang_total")])
    sources = stored(made.withColumn("absent", _share(zero, F.col("total"), F.col("v"), scale)), "source-totals")
    shares = counts.join(sources, ["lang", "source"]).select(
        "lang", "source", "term", "number", "lang_n", "v", "lang_total", "absent",
        _share(F.col("n"), F.col("total"), F.col("v"), scale).alias("p"))

    # Terms that a source has more of than its language.
    over = shares.withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale))
    terms = over.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        _stray(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)

    # Pairs: every source of a language with every other of it (the result's rows), and three sums that make its value.
    ours, theirs = sources.select("lang", "source", "held", "v", "absent"), sources.select(
        "lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("absent").alias("item_absent"))
    pairs = ours.join(theirs, "lang").filter("source <> item")
    neither = F.when(F.col("v") > 0, _stray(F.col("absent"), F.col("item_absent")) * (F.col("v") - F.col("held") - F.col("item_held"))).otherwise(zero)
    wide = "decimal(38,0)"
    by_share = (counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(sources, ["lang", "source"])
                .select("lang", "source", "terms", _share(F.col("n"), F.col("total"), F.col("v"), scale).alias("p")))
    alone = (by_share.join(theirs, "lang").filter("source <> item")
             .groupBy("lang", "source", "item").agg(F.sum((_stray(F.col("p"), F.col("item_absent")) * F.col("terms")).cast(wide)).alias("more")))
    lacked = (by_share.withColumnRenamed("source", "item").join(ours, "lang").filter("source <> item")
              .groupBy("lang", "source", "item").agg(F.sum((_stray(F.col("absent"), F.col("p")) * F.col("terms")).cast(wide)).alias("more")))
    both = (shares.select("number", "lang", "source", "p", "absent").repartition("number").sortWithinPartitions("number")
            .mapInArrow(_shared_terms(), "lang string, source string, item string, more bigint"))
    base = pairs.select("lang", "source", "item", neither.cast(wide).alias("more"))
    value = base
    for part in (alone, lacked, both):
        value = value.unionByName(part.withColumn("more", F.col("more").cast(wide)))
    value = value.groupBy("lang", "source", "item").agg(F.sum("more").cast("bigint").alias("value"))
    pairs = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    return pairs.unionByName(terms)
