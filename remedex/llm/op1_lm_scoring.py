"""LM scoring by a hierarchical Pitman-Yor model.

There is one restaurant for every previous word, by its full 64-bit hash, and they share the empty context, the root.
The dishes are words; the root draws new ones from an open base, so the mass of an unseen word is that of a new table at
the root.  Contexts and words grow with the corpus; nothing but the root's totals and the hot words goes to every task.

Seating is sampled by Gibbs sweeps.  All customers of a dish in a restaurant leave, and are seated anew one after the
other, given the tables of the last sweep: a customer opens a table with weight (strength + discount * tables) * parent
probability, and joins one with weight (customers - discount * tables).  Long runs of customers are skipped to the next
possible new table and thinned, which samples the same seating.  Restaurants are swept at the same time, so a sweep sees
the others' tables as the last sweep left them.  After the first sweep, the predictive probabilities of all sweeps are
averaged.  Buckets are sampled from a seed of their own, so tasks can be run again.

A cell is a (word, previous word) of any document, with its training customers (none, if only held-out documents have
it).  A cell of one customer has one table whatever happens, so only the live cells, of two customers or more, are swept;
the tables of the others are counted once.  Cells are dealt to buckets by the word's hash, so a word's tables lie
together; those of hot words (a thousandth of the tokens of a sample of the documents, a thousand words at most) are
dealt to further buckets by both words, and only their totals go to all tasks.  A context's customers and fixed tables
lie at its home; for a sweep, each bucket sends the tables of its live contexts there and gets the sums back, so a
context of any share is one entry for each bucket.

Counts of cells are summed within a chunk of documents before they are dealt.  For scoring, a chunk sends its cells and
the documents that they occur in to the cell's bucket, which answers with sums for each document; this is done in
``PASSES`` groups of buckets, so that a part of the cells is on disk at a time.  Numbers travel as byte planes, as wide as
the largest, and sorted hashes as differences.

Defined cases: a null text is empty and has the end token alone; rows of one doc_id are one document whose figures add
up, and null ids are one document; with no training documents all words are unknown; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.llm.common import _LOWER, ByteHash, Scratch, concat, gather, groups, mix, release, slices, small_batches, table, word_bounds

NAME = "op1_lm_scoring"
SWEEPS, BURN, PASSES = 4, 1, 2
#: Discounts and strengths of the root and of the contexts.
DISCOUNT, STRENGTH = (0.75, 0.9), (20.0, 20.0)
BYTES_PER_BUCKET, TOKENS_PER_CHUNK, HOT_SHARE, HOT_TOKENS = 16 << 20, 1_000_000, 1000, 6_000_000
SAMPLE = 16 << 20  # characters of the documents that hot words are found in; they decide where cells lie, not what they hold
END = mix(np.array([0x5EED], dtype=np.uint64))[0]
NO_ID = -(1 << 63)


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together until they hold enough text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += int(b["text"].str.len().sum())
        if size > 6 * TOKENS_PER_CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as many as the largest takes; ``unpack`` reads them."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return len(x).to_bytes(4, "little") + x.view(np.uint8).reshape(len(x), 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if len(b) > 4:
        planes = np.frombuffer(b, np.uint8, offset=4).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def numbers(b: bytes) -> np.ndarray:
    return unpack(b).view(np.int64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of each dish after its customers are seated one by one. ``weight`` is that of a new table."""
    t = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    k = np.ones(len(live), dtype=np.int64)
    while len(live):
        a, now = weight[live], t[live]
        p = np.clip(a / (k - discount * now + a), 1e-12, 1.0)  # falls with every customer until a table is opened
        k = k + rng.geometric(p)
        there = a / (np.maximum(k - 1, 1) - discount * now + a)
        opened = (k <= customers[live]) & (rng.random(len(live)) * p < there)
        t[live[opened]] += 1
        go = k < customers[live]
        live, k = live[go], k[go]
    return t


def pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words, the cell (word number << 32 | number of the previous word) of every token, and the number
    of tokens of each text. The words of a text are followed by the end, which also stands before the first."""
    parts = [_hashes(texts[lo:hi]) for lo, hi in slices([len(t) for t in texts], 1 << 20)]
    word, n = (np.concatenate([x[i] for x in parts]) for i in range(2)) if parts else _hashes(texts)
    words, number = np.unique(word, return_inverse=True)
    number = number.astype(np.uint64)
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.cumsum(n) - n] = np.searchsorted(words, END)
    return words, number << np.uint64(32) | before, n


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, bounds = concat(texts)
    buf = _LOWER[buf]
    starts, ends, n = word_bounds(buf, bounds)
    word = ByteHash(buf).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return np.insert(word, np.cumsum(n), END), n + 1


def encoded(texts) -> list[bytes]:
    return [t.encode(errors="surrogatepass") for t in texts]


class Deal:
    """The bucket of each cell: by its word, or for hot words by both words."""

    def __init__(self, buckets: int, hot: np.ndarray, salts: int):
        self.buckets, self.hot, self.salts = buckets, hot, salts

    def __call__(self, words: np.ndarray, number: np.ndarray, context: np.ndarray) -> np.ndarray:
        at = (words % np.uint64(self.buckets)).astype(np.int64)[number]
        own = np.isin(words, self.hot)[number]
        at[own] = self.buckets + (mix(words[number[own]] ^ mix(context[own])) % np.uint64(self.salts)).astype(np.int64)
        return at


def runs_of(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and how often each stands there."""
    first = np.flatnonzero(np.append(number[:-1] != number[1:], len(number) > 0)) + 1  # the ends of the runs
    return number[first - 1], np.diff(first, prepend=0)


def frequent(docs: DataFrame, size: int) -> pd.DataFrame:
    """word, n, share: the words with at least a thousandth of the tokens of a sample of the documents."""
    if size > SAMPLE:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(size // SAMPLE + 1)) == 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, chunks(batches)):
            words, cell, _ = pairs(encoded(b["text"]))
            n = np.bincount((cell >> np.uint64(32)).astype(np.int64), minlength=len(words))
            yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    n = docs.select("doc_id", "text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    top = n.crossJoin(total).where(F.col("n") * HOT_SHARE >= F.col("total")).orderBy("word").toPandas()  # HOT_SHARE rows at most
    return top.assign(share=top["n"] / top["total"])


def homes_of(names: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of a bucket in the order of their homes, these homes, and the number of contexts of each."""
    at = (mix(names) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return order, *runs_of(at[order])


def parts(words: np.ndarray, cells: np.ndarray, deal: Deal) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For each bucket its cells of a chunk (places in ``cells``), and their words, runs, contexts and names packed."""
    number, before = (cells >> np.uint64(32)).astype(np.int64), (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = deal(words, number, words[before])
    order, lo = np.argsort(at.astype(np.uint16) if deal.buckets + deal.salts < 1 << 16 else at, kind="stable"), 0
    for k, size in zip(*runs_of(at[order]), strict=True):
        part = order[lo : lo + size]
        lo += size
        kinds, runs = runs_of(number[part])
        used, own = np.unique(before[part], return_inverse=True)
        yield int(k), part, [pack_sorted(words[kinds]), pack(runs), pack(own), pack_sorted(words[used])]


CELLS = "bucket int, words binary, runs binary, contexts binary, names binary, counts binary"
LIVE = f"{CELLS}, fixed binary, tables binary, samples array<binary>, rest long, v long, train long, n long, base binary, hot binary"
OCCURS = f"{CELLS}, chunk long, docs binary, times binary, ids binary"
REPLY = "chunk long, ids binary, tokens binary, known binary, base binary, score binary"
ASK = "home int, bucket int, kind int, names binary, x array<binary>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Cells:
    """The cells of a bucket, sorted by word and previous word. ``names`` are the sorted hashes of the previous words,
    ``context`` the place of each cell's one among them, ``c`` the training customers."""

    def __init__(self, row):
        self.bucket, self.words, self.runs = int(row.bucket), unpack_sorted(row.words), numbers(row.runs)
        self.names, self.context, self.c = unpack_sorted(row.names), numbers(row.contexts), numbers(row.counts)
        self.word = np.repeat(np.arange(len(self.words), dtype=np.int32), self.runs)

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, x, len(self.words)).astype(np.int64)


def counts(docs: DataFrame, deal: Deal) -> DataFrame:
    """The cells of each bucket with their training customers, one row for each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, chunks(batches)):
            words, cell, n = pairs(encoded(b["text"]))
            cells, which = np.unique(cell, return_inverse=True)
            c = np.bincount(which, np.repeat(~b["held"].to_numpy(bool), n), len(cells)).astype(np.int64)
            yield pd.DataFrame([(k, *packed, pack(c[part])) for k, part, packed in parts(words, cells, deal)], columns=_names(CELLS))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["bucket"]):
            word = np.concatenate([np.repeat(unpack_sorted(w), numbers(r)) for w, r in zip(g["words"], g["runs"], strict=True)])
            context = np.concatenate([unpack_sorted(n)[numbers(x)] for n, x in zip(g["names"], g["contexts"], strict=True)])
            order = np.lexsort((context, word))
            word, context = word[order], context[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
            c = np.add.reduceat(np.concatenate([numbers(x) for x in g["counts"]])[order], first)
            names, local = np.unique(context[first], return_inverse=True)
            words, runs = runs_of(word[first])
            yield pd.DataFrame([(int(g["bucket"].iloc[0]), pack_sorted(words), pack(runs), pack(local), pack_sorted(names), pack(c))], columns=_names(CELLS))

    return gather(docs.mapInPandas(count, CELLS), ["bucket"]).mapInPandas(merge, CELLS)


class Live(Cells):
    """The live cells of a bucket with their tables now and after each sweep that counts, the fixed tables of their words,
    and figures of the whole bucket: fixed tables, kinds of words, training tokens."""

    def __init__(self, row):
        super().__init__(row)
        self.fixed, self.t, self.samples = numbers(row.fixed), numbers(row.tables), list(row.samples)
        self.rest, self.v, self.train, self.base = int(row.rest), int(row.v), int(row.train), row.base

    def row(self, deal: Deal) -> pd.DataFrame:
        """The state as a row. Tables and customers of hot words lie in many buckets and are added up by the driver."""
        hot = None
        if self.base is not None:
            hot = np.frombuffer(self.base, "<i8").reshape(2, -1).copy()
            hot[0, np.searchsorted(deal.hot, self.words)] += self.per_word(self.t)
            hot = hot.tobytes()
        cells = (self.bucket, pack_sorted(self.words), pack(self.runs), pack(self.context), pack_sorted(self.names), pack(self.c))
        return pd.DataFrame([(*cells, pack(self.fixed), pack(self.t), self.samples, self.rest, self.v, self.train, self.rest + int(self.t.sum()), self.base, hot)], columns=_names(LIVE))

    def sweep(self, k: int, g: dict, tables: np.ndarray, deal: Deal, seed: int) -> None:
        """Seat the customers anew, given the tables of the contexts."""
        n = self.fixed + self.per_word(self.t) if self.base is None else g["hot"][0][np.searchsorted(deal.hot, self.words)]
        new = (STRENGTH[1] + DISCOUNT[1] * tables[self.context]) * root(n, g)[self.word]
        self.t = seat(self.c, new, DISCOUNT[1], np.random.default_rng((seed, self.bucket, k)))
        if k >= BURN:
            self.samples.append(pack(self.t))


def root(n: np.ndarray, g: dict) -> np.ndarray:
    """Probability of words with n tables at the root."""
    return np.where(n > 0, n - DISCOUNT[0], STRENGTH[0] + DISCOUNT[0] * g["v"]) / (STRENGTH[0] + g["n"])


def live(cells: DataFrame, deal: Deal) -> DataFrame:
    """The live cells of each bucket, each dish at one table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x = Cells(r)
                own, fixed, base = x.c > 1, x.per_word(x.c == 1), None
                kinds, runs = runs_of(x.word[own])
                used, at = np.unique(x.context[own], return_inverse=True)
                if x.bucket >= deal.buckets:
                    base = np.zeros((2, len(deal.hot)), np.int64)
                    base[:, np.searchsorted(deal.hot, x.words)] = fixed, x.per_word(x.c)
                    base = base.tobytes()
                v = int((x.per_word(x.c) > 0).sum()) if base is None else 0
                packed = (x.bucket, pack_sorted(x.words[kinds]), pack(runs), pack(at), pack_sorted(x.names[used]), pack(x.c[own]), pack(fixed[kinds]), pack(np.ones(int(own.sum()), np.int64)))
                row = pd.DataFrame([(*packed, [], int((x.c == 1).sum()), v, int(x.c.sum()), 0, base, None)], columns=_names(LIVE))
                yield Live(next(row.itertuples(index=False))).row(deal)

    return cells.mapInPandas(run, LIVE)


def asked(rows: DataFrame, homes: int, kind: int, values) -> DataFrame:
    """The contexts of each bucket dealt to their homes, with some numbers for each; ``values`` makes them of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                names, x = values(r)
                if not len(names):
                    continue
                order, at, size = homes_of(names, homes)
                ends = np.cumsum(size)
                yield pd.DataFrame([(int(h), int(r.bucket), kind, pack_sorted(names[order[e - n : e]]), [pack(v[order[e - n : e]]) for v in x]) for h, e, n in zip(at, ends, size, strict=True)], columns=_names(ASK))

    return rows.mapInPandas(run, ASK)


def _totals(x: Cells, *cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names of the contexts, and sums over the cells of each."""
    return x.names, [np.bincount(x.context, v, len(x.names)).astype(np.int64) for v in cells]


def _count_values(r):
    x = Cells(r)
    return _totals(x, x.c, x.c == 1)


def _table_values(r):
    x = Live(r)
    return _totals(x, x.t)


def _sample_values(r):
    x = Live(r)
    return _totals(x, *map(numbers, x.samples))


def _no_values(r):
    return unpack_sorted(r.names), []


def at_home(cells: DataFrame, homes: int) -> DataFrame:
    """The customers and fixed tables of the contexts of each home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["home"]):
            names, which = np.unique(np.concatenate([unpack_sorted(x) for x in g["names"]]), return_inverse=True)
            sums = [np.bincount(which, np.concatenate([numbers(x[i]) for x in g["x"]]), len(names)) for i in range(2)]
            yield pd.DataFrame([(int(g["home"].iloc[0]), -1, 0, pack_sorted(names), [pack(v) for v in sums])], columns=_names(ASK))

    return gather(asked(cells, homes, 0, _count_values), ["home"]).mapInPandas(run, ASK)


def answers(home: DataFrame, rows: DataFrame, m: int) -> DataFrame:
    """bucket, home, x: customers of the contexts asked for, and their tables in each of m seatings.

    Rows of kind 1 bring tables, those of kind 2 want sums, and those of kind 3 do both.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["home"]):
            at = {}
            for i, r in enumerate(g.itertuples(index=False)):
                if not r.kind:
                    names, (customers, fixed) = unpack_sorted(r.names), map(numbers, r.x)
                    tables = [fixed.copy() for _ in range(m)]
                    continue
                at[i] = np.searchsorted(names, unpack_sorted(r.names))
                if r.kind != 2:
                    for t, x in zip(tables, r.x, strict=True):
                        t[at[i]] += numbers(x)
            out = [(int(r.bucket), int(r.home), [pack(v[at[i]]) for v in (customers, *tables)]) for i, r in enumerate(g.itertuples(index=False)) if r.kind > 1]
            if out:
                yield pd.DataFrame(out, columns=["bucket", "home", "x"])

    dealt = home.unionByName(rows).repartition("home").sortWithinPartitions("home", "kind", "bucket")
    return dealt.mapInPandas(run, "bucket int, home int, x array<binary>")


def root_totals(rows: DataFrame, deal: Deal) -> dict:
    """Tables and kinds of words at the root, training tokens, and tables and customers of the hot words."""
    found = rows.select("n", "v", "train", "hot").collect()  # one small row for each bucket
    hot = sum((np.frombuffer(r.hot, "<i8").reshape(2, -1) for r in found if r.hot is not None), np.zeros((2, len(deal.hot)), np.int64))
    return {"n": sum(r.n for r in found), "v": sum(r.v for r in found) + int((hot[1] > 0).sum()), "train": sum(r.train for r in found), "hot": hot}


class Replies:
    """What the homes answer for the contexts of a bucket, put in the order of its names."""

    def __init__(self, names: np.ndarray, homes: int):
        order, at, size = homes_of(names, homes)
        ends = np.cumsum(size)
        self.n, self.place = len(names), {int(h): order[e - k : e] for h, e, k in zip(at, ends, size, strict=True)}
        self.x: list[np.ndarray] = []

    def add(self, home: int, x) -> None:
        if not self.x:
            self.x = [np.zeros(self.n, np.int64) for _ in x]
        for to, v in zip(self.x, x, strict=True):
            to[self.place[home]] = numbers(v)


def swept(rows: DataFrame, home: DataFrame, k: int, g: dict, deal: Deal, seed: int) -> DataFrame:
    """The live cells after sweep k."""
    back = answers(home, asked(rows, deal.buckets, 3, _table_values), 1)
    both = rows.withColumn("home", F.lit(-1)).unionByName(back, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "home")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, replies = None, None

        def done() -> pd.DataFrame:
            x.sweep(k, g, replies.x[1] if replies.x else np.zeros(0), deal, seed)
            return x.row(deal)

        for b in batches:
            for r in b.itertuples(index=False):
                if r.home >= 0:
                    replies.add(int(r.home), r.x)
                    continue
                if x is not None:
                    yield done()
                x = Live(r)
                replies = Replies(x.names, deal.buckets)
        if x is not None:
            yield done()

    return both.mapInPandas(run, LIVE)


def trained(cells: DataFrame, home: DataFrame, scratch: Scratch, deal: Deal, seed: int) -> tuple[DataFrame, list[dict]]:
    """The live cells after all sweeps, and the totals of the root after each sweep that counts."""
    state, out = scratch.put(live(cells, deal), "l0"), []
    g = root_totals(state, deal)
    for k in range(SWEEPS):
        state = scratch.put(swept(state, home, k, g, deal, seed), f"l{k + 1}")
        g = root_totals(state, deal)
        scratch.drop(f"l{k}")
        release(state.sparkSession)
        if k >= BURN:
            out.append(g)
    return state, out


def averaged(x: Cells, samples: list[np.ndarray], replies: list[np.ndarray], totals: list[dict], deal: Deal) -> np.ndarray:
    """The predictive probability of each cell, averaged over the seatings (tables of its live cells)."""
    customers, sums = replies[0], np.zeros(len(x.c))
    for tables, own, g in zip(replies[1:], samples, totals, strict=True):
        t = np.minimum(x.c, 1)
        t[x.c > 1] = own
        n = x.per_word(t) if x.bucket < deal.buckets else g["hot"][0][np.searchsorted(deal.hot, x.words)]
        sums += x.c - DISCOUNT[1] * t + (STRENGTH[1] + DISCOUNT[1] * tables[x.context]) * root(n, g)[x.word]
    return sums / len(totals) / (STRENGTH[1] + customers[x.context])


def occurrences(docs: DataFrame, deal: Deal, turn: int, turns: int) -> DataFrame:
    """The cells of a chunk by bucket, and the documents that they occur in with the times, for one turn's buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, chunks(batches)):
            words, cell, n = pairs(encoded(b["text"]))
            ids, bits = b["doc_id"].to_numpy(), len(b).bit_length()
            del b
            cells, which = np.unique(cell, return_inverse=True)
            key = np.sort(which << bits | np.repeat(np.arange(len(ids)), n))  # by cell and document
            del cell, which
            key, times = runs_of(key)
            doc = key & ((1 << bits) - 1)
            each = np.bincount(key >> bits, minlength=len(cells))
            chunk = int(np.bitwise_xor.reduce(mix(mix(ids.astype(np.uint64)) + np.arange(len(ids), dtype=np.uint64))).view(np.int64))
            del key
            start = np.cumsum(each) - each
            rows = []
            for k, part, packed in parts(words, cells, deal):
                if k % turns != turn:
                    continue
                size = each[part]
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(start[part] - ends + size, size)
                used, own = np.unique(doc[at], return_inverse=True)
                rows.append((k, *packed, pack(size), chunk, pack(own), pack(times[at]), ids[used].astype("<i8").tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=_names(OCCURS))

    return docs.mapInPandas(run, OCCURS)


def score(found: DataFrame, cells: DataFrame, state: DataFrame, back: DataFrame, totals: list[dict], deal: Deal) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document, for the buckets of ``cells``.

    A bucket answers a chunk with one row of sums, and the sums of a chunk meet there.
    """
    sides = (cells, state.select("bucket", "samples"), back, found)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("side", F.lit(i)) for i, df in enumerate(sides)])
    train, v = totals[-1]["train"], totals[-1]["v"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                if r.side == 0:
                    x = Cells(r)
                    cell, log_p, replies = x.word * np.int64(len(x.names)) + x.context, None, Replies(x.names, deal.buckets)
                    known = x.per_word(x.c) if x.bucket < deal.buckets else totals[-1]["hot"][1][np.searchsorted(deal.hot, x.words)]
                elif r.side == 1:
                    samples = [numbers(t) for t in r.samples]
                elif r.side == 2:
                    replies.add(int(r.home), r.x)
                else:
                    if log_p is None:
                        log_p = np.log10(averaged(x, samples, replies.x, totals, deal))
                    w = np.repeat(np.searchsorted(x.words, unpack_sorted(r.words)), numbers(r.runs))
                    at = np.searchsorted(cell, w * len(x.names) + np.searchsorted(x.names, unpack_sorted(r.names))[numbers(r.contexts)])  # every cell is there
                    each, doc, times, ids = numbers(r.counts), numbers(r.docs), numbers(r.times), np.frombuffer(r.ids, "<i8")
                    c = known[w]
                    base = np.log10((c + 1) / (train + v + 1))
                    known_, base_, score_ = (np.bincount(doc, np.repeat(y, each) * times, len(ids)) for y in (c > 0, base, log_p[at]))
                    yield pd.DataFrame([(int(r.chunk), r.ids, pack(np.bincount(doc, times, len(ids))), pack(known_), base_.tobytes(), score_.tobytes())], columns=_names(REPLY))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["chunk"]):
            ids, which = np.unique(np.frombuffer(b"".join(g["ids"]), "<i8"), return_inverse=True)
            whole = [np.bincount(which, np.concatenate([numbers(x) for x in g[k]]), len(ids)).astype(np.int64) for k in ("tokens", "known")]
            real = [np.bincount(which, np.frombuffer(b"".join(g[k])), len(ids)) for k in ("base", "score")]
            yield pd.DataFrame(dict(zip(("doc_id", *FIGURES), (ids, *whole, *real), strict=True)))

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "side", "home")
    return gather(dealt.mapInPandas(run, REPLY), ["chunk"]).mapInPandas(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")


FIGURES = ("n_tokens", "n_known", "base_score", "score")


def _per_document(sums: DataFrame) -> DataFrame:
    return sums.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in FIGURES])


def lm_scores(docs: DataFrame, scratch: Scratch, seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2, F.lit(False))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    top = frequent(rows, size)
    salts = int(top["share"].sum() * size / 6 // HOT_TOKENS) + 1
    deal = Deal(int(size // BYTES_PER_BUCKET) + 1, np.sort(top["word"].to_numpy(np.int64).view(np.uint64)), salts)
    cells = scratch.put(counts(rows, deal), "cells")
    release(spark)
    home = scratch.put(at_home(cells, deal.buckets), "home")
    release(spark)
    state, totals = trained(cells, home, scratch, deal, seed)
    sums = []
    for turn in range(PASSES):
        own = cells.where(F.col("bucket") % PASSES == turn)
        questions = asked(own.select("bucket", "names"), deal.buckets, 2, _no_values)
        back = answers(home, questions.unionByName(asked(state, deal.buckets, 1, _sample_values)), len(totals))
        found = score(occurrences(rows, deal, turn, PASSES), own, state.where(F.col("bucket") % PASSES == turn), back, totals, deal)
        sums.append(scratch.put(_per_document(found), f"sums{turn}"))
        del own, questions, back, found
        release(spark)
    out = _per_document(reduce(DataFrame.unionByName, sums)).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(totals[-1]["train"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return lm_scores(table(spark, sf_dir, "documents"), scratch)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base on held-out documents."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.where("held_out").agg(per("score").alias("model"), per("base_score").alias("base"))
