"""Benchmark passages in documents, by an FM-index for each shard of the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import keep_columns, map_texts, ship_package
from docloom.llm.words import WORDS_SQL, blocks, words_of

WINDOW = 10
SHARD_WORDS = 1 << 20  # words in one index, unless one document has more
SAMPLE = 8  # every so many suffix positions are kept
BLOCK_BYTES = 16 << 20  # benchmark text sent to all tasks at once; more of it is searched block by block


class Windows:
    """Distinct windows of benchmark items as rows of symbols. Symbol 0 stands for every word that no item has."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        cut: dict[bytes, set] = {}
        for item, text in items:
            h = words_of((text or "").encode("utf-8", "surrogatepass"))[2]
            for i in range(max(1, len(h) - size + 1) if len(h) else 0):
                cut.setdefault(h[i : i + size].tobytes(), set()).add(item)
        rows = [np.frombuffer(k, np.uint64) for k in cut]
        self.items = [sorted(v, key=str) for v in cut.values()]
        self.alphabet = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.symbols = np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            self.symbols[i, : len(r)] = np.searchsorted(self.alphabet, r) + 1
        self.shortest = int(self.lengths.min()) if rows else 0

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, 0)


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. Each 0 ends a run and differs from every other 0, earlier ones being smaller."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    step, order = 1, np.argsort(rank, kind="stable")
    while True:
        ranked = rank[order]
        new = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Burrows-Wheeler transform of runs of symbols, ranks by a wavelet matrix, sampled suffix positions."""

    def __init__(self, text: np.ndarray, largest: int):
        order = _suffix_order(text)
        self.size = len(text)
        self.last = np.where(order > 0, text[order - 1], 0)  # the symbol before each suffix
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)  # beginnings of runs too: no walk crosses a border
        self.positions = np.where(self.sampled, order, 0)
        self.levels, left = [], self.last
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (left >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), int((~ones).sum())))
            left = np.concatenate([left[~ones], left[ones]])

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that begin with ``symbol`` and go on as those before ``row``."""
        zero = np.zeros_like(row)
        for bit, ones, zeros in self.levels:
            up = (symbol >> bit & 1).astype(bool)
            row = np.where(up, zeros + ones[row], row - ones[row])
            zero = np.where(up, zeros + ones[zero], zero - ones[zero])
        return self.below[symbol] + row - zero

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place in the text) of every occurrence."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            more = lengths[which] >= back
            symbol = patterns[which, np.maximum(lengths[which] - back, 0)]
            low = np.where(more, self._step(symbol, low), low)
            high = np.where(more, self._step(symbol, high), high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        times = high - low
        found = np.repeat(which, times)
        row = np.repeat(low, times) + np.arange(len(found)) - np.repeat(np.cumsum(times) - times, times)
        walked = np.zeros(len(found), np.int64)
        away = np.flatnonzero(~self.sampled[row])
        while len(away):
            row[away] = self._step(self.last[row[away]], row[away])
            walked[away] += 1
            away = away[~self.sampled[row[away]]]
        return found, self.positions[row] + walked


def _occurrences(windows: Windows, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in some documents; document d has the words first[d] to first[d + 1].

    Only runs of benchmark words that are long enough for a window are indexed; other words cannot be in one."""
    symbols = windows.encode(hashes)
    border = np.zeros(len(symbols) + 1, bool)
    border[first] = True
    known = symbols > 0
    begin = known & (np.concatenate([[True], ~known[:-1]]) | border[:-1])
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = ~known
    stops = np.flatnonzero(np.concatenate([stop | border[:-1], [True]]))
    ends = stops[np.searchsorted(stops, starts, "right")]
    long = ends - starts >= windows.shortest
    starts, ends = starts[long], ends[long]
    found = []
    at = 0
    sizes = np.cumsum(ends - starts + 1)
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SHARD_WORDS, "right")))
        s, n = starts[at:upto], (ends - starts)[at:upto]
        place = np.repeat(s, n + 1) + np.arange(int((n + 1).sum())) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        text = symbols[np.minimum(place, len(symbols) - 1)].copy()
        text[np.cumsum(n + 1) - 1] = 0
        window, where = FMIndex(text, len(windows.alphabet)).search(windows.symbols, windows.lengths)
        found.append((window, place[where]))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _search(windows: Windows, texts: list[str | None]) -> Iterator[tuple[int, set, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Per text: number of words, items met, merged spans in words and in bytes."""
    for i, j, _, begins, first, starts, ends, hashes in blocks(texts):
        window, word = _occurrences(windows, hashes, first)
        doc = np.searchsorted(first, word, "right") - 1
        order = np.lexsort((word, doc))
        window, word, doc = window[order], word[order], doc[order]
        until = word + windows.lengths[window] if len(word) else word
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            items, spans = set(), []
            for k in range(bounds[d], bounds[d + 1]):
                a, b = int(word[k]), int(until[k])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for w in np.unique(window[bounds[d] : bounds[d + 1]]).tolist():
                items.update(windows.items[w])
            base, at = int(first[d]), int(begins[d])
            yield (
                int(first[d + 1]) - base,
                items,
                [(a - base, b - base) for a, b in spans],
                [(int(starts[a]) - at, int(ends[b - 1]) - at) for a, b in spans],
            )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw, at, left = text.encode("utf-8", "surrogatepass"), 0, []
    for a, b in spans:
        left.append(raw[at:a])
        at = b
    return b"\n".join([*left, raw[at:]]).decode("utf-8", "surrogatepass")


def _blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[Windows]:
    """The benchmark in blocks whose text has a bounded size, dealt by a hash of the row."""
    size = benchmark.select(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k) if n > 1 else benchmark
        yield Windows([(r[0], r[1]) for r in part.select(item, text).collect()])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", clean: bool = False) -> DataFrame:
    """Which documents hold windows of ten consecutive words of benchmark items, and where.

    Without ``clean``: ``key``, n_words, n_hit (words inside any window), items (ids of the items met, as strings, sorted)
    and spans (merged, in words). With ``clean``: all columns of ``docs`` with the hit spans cut out of ``text`` (a line break
    is left in each place, and the search is repeated until no window is left) and n_hit, items beside them.

    Items shorter than ten words are one window; items and texts without words, and nulls, match nothing. A null item id
    is written as None. Equal rows get equal results; empty tables give no rows or no hits. Input columns n_hit and items
    are replaced if ``clean``.

    The windows of at most ``BLOCK_BYTES`` of benchmark text are sent to all tasks; a larger benchmark is searched block
    after block, and the finds of a document are put together in its row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = [spark.sparkContext.broadcast(w) for w in _blocks_of(benchmark, item, text)]
    kept = keep_columns(docs, ["n_hit", "items"]) if clean else [key]

    def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def search(texts: list[str | None]) -> list[tuple[int, set, list, list]]:
        found = [list(_search(s.value, texts)) for s in shared]
        if len(found) == 1:
            return found[0]
        return [(x[0][0], set().union(*(y[1] for y in x)), merged([s for y in x for s in y[2]]), merged([s for y in x for s in y[3]])) for x in zip(*found, strict=True)]

    def run(texts: list[str | None]) -> dict[str, list]:
        found = search(texts)
        n_hit, items = [sum(y - x for x, y in f[2]) for f in found], [set(f[1]) for f in found]
        if clean:
            dirty = [i for i, f in enumerate(found) if f[3]]
            hits = {i: found[i] for i in dirty}
            while dirty:
                for i in dirty:
                    texts[i] = _without(texts[i], hits[i][3])
                again = search([texts[i] for i in dirty])
                hits = {i: f for i, f in zip(dirty, again, strict=True) if f[3]}
                for i, f in hits.items():
                    n_hit[i] += sum(y - x for x, y in f[2])
                    items[i] |= f[1]
                dirty = list(hits)
            made = {text: texts}
        else:
            made = {"n_words": [f[0] for f in found], "spans": [[{"start": x, "end": y} for x, y in f[2]] for f in found]}
        return made | {"n_hit": n_hit, "items": [sorted(map(str, x)) for x in items]}

    if clean:
        out = map_texts(docs, run, f"`{text}` string, n_hit long, items array<string>", [c for c in kept if c != text], text)
        return out.select(*kept, "n_hit", "items")
    return map_texts(docs.select(key, text), run, "n_hit long, items array<string>, n_words long, spans array<struct<start:long,end:long>>", [key], text)


def op7_benchmark_decontamination(spark, sf):
    found = find_benchmark(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
with dw as (select doc_id, {WORDS_SQL} as w from documents),
bw as (select item_id, {WORDS_SQL} as w from benchmark),
wins as (
  select item_id, least(len(w), 10) as n, md5(array_to_string(w[i:i + 9], ' ')) as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from bw where len(w) > 0)),
spots as (
  select doc_id, n, i, md5(array_to_string(w[i:i + n - 1], ' ')) as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from wins) where len(w) >= n)),
met as (select doc_id, item_id, i, s.n from spots s join wins using (win, n)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from met) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
""".replace("{WORDS_SQL}", WORDS_SQL)

QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
ORACLES = {"op7_benchmark_decontamination": ORACLE}
