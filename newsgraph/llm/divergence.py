"""Divergence of the term profiles of sources, by row accumulation over a term-major index.

A profile is a sparse row: the share of each kept term, and one baseline share for all terms that do not occur. The
distance of two rows is a sum over all kept terms. A row starts every peer at the distance as if they shared no term
(own terms against the peer's baseline, the peer's terms against the own baseline, baselines elsewhere). Then it
scatters its terms through the index: each meets its postings and corrects the accumulators of those peers, which are
one dense array. No pair of postings is ever a row of a table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import LOWER, UPPER, map_arrow
from newsgraph.session import stored

LEAST_DOCS = 30  # production parameter: a kept term is in at least this many documents of its language
TOP_TERMS = 50  # production parameter: length of the report of a group's own terms
SCALE, PRIOR = 1_000_000_000, 5
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = str.maketrans(UPPER, LOWER)
_HELD = 1 << 18  # entries a task holds before it hands on its partial counts
SHARD_ENTRIES = 1 << 16  # index entries of a cell
CELL_COUNTERS = 1 << 21  # accumulators of a cell


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` as partial counts: occurrences, and documents with the term. NULL is ''.
    Each group has a row without a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}

        def handed_on() -> pa.RecordBatch:
            out = [(g[0], g[1], t, n, within[g][t]) for g, own in times.items() for t, n in own.items()]
            out += [(g[0], g[1], None, 0, 0) for g in times]
            columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            times.clear()
            within.clear()
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "source", "term", "n", "docs"]
            )

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (lang or "", source or "")
                own = times.setdefault(group, Counter())
                found = _TERM.findall((text or "").translate(_FOLD))
                before = len(own)
                own.update(found)
                within.setdefault(group, Counter()).update(set(found))
                held += len(own) - before
                if held >= _HELD:
                    yield handed_on()
                    held = 0
        yield handed_on()

    schema = "lang string, source string, term string, n long, docs long"
    return map_arrow(docs.select("lang", "source", "text"), count, schema)


def share(count: str, total: str, kinds: str) -> Column:
    """The smoothed share of a term in billionths from the names of its count, its group's total and the number of
    kept terms; exact at any size of the counts. 0 without kept terms."""
    over = f"((CAST({count} AS DECIMAL(20, 0)) + {PRIOR}) * {SCALE})"
    under = f"(CAST({total} AS DECIMAL(20, 0)) + {PRIOR} * CAST({kinds} AS DECIMAL(17, 0)))"
    return F.expr(f"IF({kinds} = 0, 0, 1 + {over} DIV {under})").cast("long")


class Profiles:
    """The kept terms of each language and the shares of its groups, stored once.

    ``groups``: lang, source, number (0, 1, ... within the language), total, kinds (kept terms), base (the share of a
    term that does not occur), held (kept terms that occur), peers (groups of the language).
    ``entries``: lang, term, number, share, where the count is not 0. ``languages``: lang, term, share.
    """

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        partial = stored(term_counts(docs), "term_counts")
        names = partial.select("lang", "source").distinct()
        # One shuffle by language and term serves the sum per group, the sum per language and the choice of terms.
        counts = partial.where("term IS NOT NULL").repartition("lang", "term")
        counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        counts = counts.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("in_lang", F.sum("n").over(of_term))
        counts = stored(counts.where(F.col("in_docs") >= least_docs).drop("docs", "in_docs"), "kept_counts")

        terms = counts.groupBy("lang", "term").agg(F.first("in_lang").alias("n"))
        kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_total"))
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
        groups = names.join(kinds, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
        of_lang = Window.partitionBy("lang").orderBy("source")
        groups = groups.withColumn("number", F.row_number().over(of_lang) - 1)
        groups = groups.withColumn("peers", F.count("*").over(Window.partitionBy("lang")))
        self.groups = stored(groups.withColumn("base", share("0", "total", "kinds")), "groups")
        own = counts.join(self.groups, ["lang", "source"])
        entries = own.select(
            "lang",
            "source",
            "term",
            "number",
            "peers",
            share("n", "total", "kinds").alias("share"),
            share("in_lang", "lang_total", "kinds").alias("lang_share"),
        )
        self.entries = stored(entries, "entries")


class _Baselines:
    """Sums of distances from many baselines at once: values are counted between the sorted baselines."""

    def __init__(self, base: np.ndarray):
        self.order = np.argsort(base, kind="stable")
        self.ranked = base[self.order]

    def distance(self, values: np.ndarray) -> np.ndarray:
        """For every baseline the sum of its distances from all values."""
        n, ranked = len(self.ranked), self.ranked
        at = np.searchsorted(ranked, values, "right")
        total = np.zeros(n + 1, np.int64)
        np.add.at(total, at, values)
        n_above = np.bincount(at, minlength=n + 1)[::-1].cumsum()[::-1][1:]
        sum_above = total[::-1].cumsum()[::-1][1:]
        n_below, sum_below = len(values) - n_above, int(values.sum()) - sum_above
        out = np.empty(n, np.int64)
        out[self.order] = sum_above - n_above * ranked + n_below * ranked - sum_below
        return out


def _rows_of_cell(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Partial distances of each row group of a cell from all peers, in order of their numbers.

    The cell holds a shard of the index (entries of some terms, all groups) after header rows (term NULL) with the
    baselines of all groups. What is summed here leaves out the baselines' own distance, which belongs to no term.
    """
    number, value, term = (cell[c].to_numpy() for c in ("number", "share", "code"))
    head = term < 0
    base = np.zeros(int(head.sum()), np.int64)
    base[number[head]] = value[head]
    first, last = int(cell["first"][0].as_py()), int(cell["last"][0].as_py())
    number, value, term = number[~head], value[~head], term[~head]
    n = len(base)

    # The index: postings in order of terms, and where those of each term begin. Entries of a group, by group.
    begin = np.searchsorted(term, np.arange(int(term[-1]) + 2)) if len(term) else np.zeros(1, np.int64)
    by_group = np.argsort(number, kind="stable")
    border = np.searchsorted(number[by_group], np.arange(n + 1))
    held = np.diff(border)
    baselines, rows = _Baselines(base), _Baselines(base[first:last])
    peers = np.empty((last - first, n), np.int64)  # each peer's entries against the baselines of the rows
    for h in range(n):
        peers[:, h] = rows.distance(value[by_group[border[h] : border[h + 1]]])

    for g in range(first, last):
        own = by_group[border[g] : border[g + 1]]
        apart = np.abs(base[g] - base)
        distance = baselines.distance(value[own]) + peers[g - first] - (held[g] + held) * apart
        # Scatter: all postings of the group's terms, one after the other.
        sizes = begin[term[own] + 1] - begin[term[own]]
        total = int(sizes.sum())
        posting = np.arange(total) + np.repeat(begin[term[own]] - (np.cumsum(sizes) - sizes), sizes)
        peer, theirs, mine = number[posting], value[posting], np.repeat(value[own], sizes)
        change = np.abs(mine - theirs) - np.abs(mine - base[peer]) - np.abs(theirs - base[g]) + apart[peer]
        np.add.at(distance, peer, change)
        yield g, distance


def distances(profiles: Profiles, shard_entries: int = SHARD_ENTRIES, counters: int = CELL_COUNTERS) -> DataFrame:
    """``lang, number, peer, value``: the distance of every two groups of a language, over all kept terms.

    A cell is a shard of a language's terms and a block of its groups. Shards follow the number of index entries and
    blocks the number of groups, so what a task holds is bounded; each cell hands on a dense row per group.
    """
    groups, entries = profiles.groups, profiles.entries
    sizes = entries.groupBy("lang").agg(F.count("*").alias("entries"))
    plan = groups.select("lang", "peers").distinct().join(sizes, "lang", "left")
    plan = plan.withColumn("shards", F.ceil(F.coalesce("entries", F.lit(1)) / shard_entries).cast("int"))
    plan = plan.withColumn("rows", F.greatest(F.lit(1), F.floor(counters / F.col("peers"))).cast("int"))
    plan = plan.withColumn("blocks", F.ceil(F.col("peers") / F.col("rows")).cast("int")).drop("entries", "peers")
    last = F.sequence(F.lit(0), F.col("blocks") - 1)
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    body = entries.join(plan, "lang").withColumn("shard", shard).withColumn("block", F.explode(last))
    head = groups.join(plan, "lang").withColumn("term", F.lit(None).cast("string"))
    head = head.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    head = head.withColumn("block", F.explode(last)).withColumn("share", F.col("base"))
    columns = ["lang", "shard", "block", "term", "number", "share", "peers", "rows"]
    cells = body.select(columns).unionByName(head.select(columns)).repartition("lang", "shard", "block")
    cells = cells.sortWithinPartitions("lang", "shard", "block", F.col("term").asc_nulls_first(), "number")

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell in _cells(batches):
            terms = cell["term"].combine_chunks()
            code = np.full(len(cell), -1, np.int64)
            filled = np.flatnonzero(terms.is_valid().to_numpy(zero_copy_only=False))
            if len(filled):
                code[filled] = terms.take(pa.array(filled)).dictionary_encode().indices.to_numpy()
            rows, peers = cell["rows"][0].as_py(), cell["peers"][0].as_py()
            first = key[2] * rows
            cell = cell.append_column("code", pa.array(code))
            cell = cell.append_column("first", pa.array(np.full(len(cell), first)))
            cell = cell.append_column("last", pa.array(np.full(len(cell), min(peers, first + rows))))
            for group, distance in _rows_of_cell(cell):
                yield pa.record_batch(
                    [pa.array([key[0]]), pa.array([group], pa.int32()), pa.array([distance], pa.list_(pa.int64()))],
                    ["lang", "number", "distance"],
                )

    rows = map_arrow(cells, accumulate, "lang string, number int, distance array<long>")
    part = rows.select("lang", "number", F.posexplode("distance").alias("peer", "value"))
    return part.groupBy("lang", "number", "peer").agg(F.sum("value").alias("value"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with the same language, shard and block, one at a time."""
    key, parts = None, []
    for batch in batches:
        codes = [batch.column(i) for i in range(3)]
        names, shard, block = codes[0].dictionary_encode(), codes[1].to_numpy(), codes[2].to_numpy()
        lang = names.indices.to_numpy()
        change = (lang[1:] != lang[:-1]) | (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if first == last:
                continue
            own = (names.dictionary[int(lang[first])].as_py(), int(shard[first]), int(block[first]))
            if own != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = own
            parts.append(batch.slice(first, last - first))
    if parts:
        yield key, pa.Table.from_batches(parts)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language (part
    ``pair``, every other source), and the terms that it uses more than its language (part ``term``, the first ``top``).

    Defined results: NULL lang, source and text are ''. Groups without terms count as groups; a language without kept
    terms has distance 0 between its sources. A language with one source has no pairs. Ties go by item in order of
    UTF-8. Repeated rows are documents of their own. Empty input: no rows. Other columns are not used.
    """
    profiles = Profiles(docs, least_docs)
    groups = profiles.groups
    rows = groups.select("lang", "number", "source", "kinds", "base")
    peer = groups.select("lang", F.col("number").alias("peer"), F.col("source").alias("item"), F.col("base").alias("other"))
    between = F.col("kinds") * F.abs(F.col("base") - F.col("other"))
    pairs = distances(profiles).where("number <> peer").join(rows, ["lang", "number"]).join(peer, ["lang", "peer"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + between).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    terms = profiles.entries.where("share > lang_share")
    value = (F.col("share") - F.col("lang_share")).alias("value")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
