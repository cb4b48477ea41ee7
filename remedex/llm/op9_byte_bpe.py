"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

The text is cut by the tokenizer's pattern.  Each distinct piece of a partition that is no token itself becomes rows
(piece, position, token, next token, merge), one for each byte.  A recursive query joins neighbouring tokens with the
merge table (every pair of tokens whose bytes together are a token, with that token's rank), and contracts the leftmost
pair of least rank of every piece, until no piece has a pair left; only rows next to a contraction are joined again.

A piece of more than ``LONG`` bytes would need as many rounds as it has merges.  Its query contracts, from left to
right, all pairs of least rank in one round, unless some neighbour of a contracted pair would then merge at a lower rank;
such a piece moves by its leftmost pair only.  Both give the same ids.  The state of long pieces is cut every ``ROUNDS``.

Decoding joins ids with the vocabulary and aggregates the bytes of each document in order.  The pieces known to a Python
worker are kept in a bounded table, so repeated words are merged once.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded one by one; ids may be
null; other columns named in ``keep`` stay, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.llm.common import Lexicon, kept, slices, small_batches, table

NAME = "op9_byte_bpe"
RANKS = "byte_bpe_multi_50k.tiktoken"
LONG, ROUNDS, MEMORY = 400, 64, "160MB"
KNOWN = 400_000  # pieces that a Python worker keeps
#: Characters cut into pieces at once, and ids decoded at once.
CUT, DECODED = 1 << 20, 1 << 18

_MERGE = """
WITH RECURSIVE state(round, piece, pos, token, after, merged) AS (
  SELECT 0, piece, pos, token, after, merged FROM bytes LEFT JOIN merges ON pair = (token::BIGINT << 24) | after
  UNION ALL
  (WITH least AS (SELECT piece, min((merged::BIGINT << 32) | pos) AS best FROM state WHERE merged IS NOT NULL GROUP BY piece),
   spot AS (SELECT least.piece, (best & 4294967295)::INT AS spot_at, (best >> 32)::INT AS made, s.after
     FROM least JOIN state s ON s.piece = least.piece AND s.pos = (best & 4294967295)::INT + 1),
   moved AS (SELECT round + 1 AS round, s.piece, if(pos > spot_at, pos - 1, pos)::INT AS pos, if(pos = spot_at, made, token) AS token,
     CASE WHEN pos = spot_at THEN spot.after WHEN pos = spot_at - 1 THEN made ELSE s.after END AS after, merged AS old, pos = spot_at OR pos = spot_at - 1 AS changed
     FROM state s JOIN spot ON s.piece = spot.piece WHERE pos <> spot_at + 1)
   SELECT round, piece, pos, token, after, if(changed, merges.merged, old) FROM moved
   LEFT JOIN merges ON pair = if(changed, (token::BIGINT << 24) | after, NULL))
)
SELECT piece, token FROM state JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) USING (piece, round) ORDER BY piece, pos
"""
#: For long pieces: every round contracts all pairs of least rank, or the leftmost one where a neighbour would go first.
_MERGE_LONG = f"""
WITH RECURSIVE state(round, piece, pos, token) AS (
  SELECT 0, piece, pos, token FROM bytes
  UNION ALL
  (WITH pairs AS (SELECT s.*, merged FROM (SELECT *, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS b FROM state) s LEFT JOIN merges ON pair = (token::BIGINT << 24) | b),
   least AS (SELECT piece, min(merged) AS made FROM pairs GROUP BY piece),
   found AS (SELECT piece, pos, made, pos - row_number() OVER (PARTITION BY piece ORDER BY pos) AS run FROM pairs JOIN least USING (piece) WHERE merged = made),
   -- Of overlapping pairs every other one, from the left.
   hits AS (SELECT piece, pos, made FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY pos) AS k FROM found) WHERE k % 2 = 1),
   near AS (SELECT p.piece, p.pos, p.token, hits.made, coalesce(hits.made, lead(hits.made) OVER w) AS own, lag(p.token, 1) OVER w AS l, lag(hits.made, 2) OVER w AS lhit, lead(p.token, 2) OVER w AS r
     FROM pairs p LEFT JOIN hits USING (piece, pos) WINDOW w AS (PARTITION BY p.piece ORDER BY p.pos)),
   early AS (SELECT DISTINCT piece FROM near JOIN merges ON pair = (coalesce(lhit, l)::BIGINT << 24) | made OR pair = (made::BIGINT << 24) | r WHERE merged < made),
   spot AS (SELECT * FROM hits WHERE piece NOT IN (SELECT piece FROM early) OR (piece, pos) IN (SELECT piece, min(pos) FROM hits GROUP BY piece)),
   moved AS (SELECT s.round + 1 AS round, s.piece, s.pos, coalesce(spot.made, s.token) AS token, lag(spot.made) OVER (PARTITION BY s.piece ORDER BY s.pos) AS gone
     FROM state s LEFT JOIN spot USING (piece, pos) WHERE s.piece IN (SELECT piece FROM spot) AND s.round < {ROUNDS})
   SELECT round, piece, (row_number() OVER (PARTITION BY piece ORDER BY pos) - 1)::INT, token FROM moved WHERE gone IS NULL)
)
SELECT piece, token, round FROM state JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) USING (piece, round) ORDER BY piece, pos
"""
_DECODE = "SELECT doc, array_to_string(list(bytes ORDER BY pos), '') AS text FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tables:
    """The merge table and the vocabulary in a database of this Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks, self.db = ranks, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        splits = ((ranks[t[:i]] << 24 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        flat = np.fromiter(chain.from_iterable(splits), dtype=np.int64)
        self.put("merges", {"pair": flat[::2], "merged": flat[1::2].astype(np.int32)})
        # A string of the code points 0 to 255 stands for bytes.
        self.put("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "bytes": [k.decode("latin-1") for k in ranks]})
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)

    def put(self, name: str, columns: dict) -> None:
        self.db.register("made", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM made")
        self.db.unregister("made")

    def ask(self, sql: str, name: str, columns: dict) -> dict[str, np.ndarray]:
        self.db.register(name, pa.table(columns))
        got = self.db.sql(sql).fetchnumpy()
        self.db.unregister(name)
        return got

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the piece and id of every token of the pieces."""
        sizes = np.array([len(p) for p in pieces])
        token = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece, pos = _places(sizes)
        short = sizes[piece] <= LONG
        after = pa.array(np.append(token[1:], 0), mask=np.append(piece[1:] != piece[:-1], True))
        got = self.ask(_MERGE, "bytes", {"piece": piece[short], "pos": pos[short], "token": token[short], "after": after.filter(pa.array(short))}) if short.any() else {"piece": piece[:0], "token": token[:0]}
        out = [(got["piece"], got["token"])]
        piece, token = piece[~short], token[~short]
        while len(piece):
            _, size = np.unique(piece, return_counts=True)
            got = self.ask(_MERGE_LONG, "bytes", {"piece": piece, "pos": _places(size)[1], "token": token})
            more = got["round"] == ROUNDS
            out.append((got["piece"][~more], got["token"][~more]))
            piece, token = got["piece"][more], got["token"][more]
        return tuple(np.concatenate([np.asarray(x[i], dtype=np.int32) for x in out]) for i in range(2))

    def encoded(self, new: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of ids of each."""
        rank = np.array([self.ranks.get(p, -1) for p in new], dtype=np.int32)
        rest, whole = np.flatnonzero(rank < 0), np.flatnonzero(rank >= 0)
        piece, token = self.merged([new[i] for i in rest]) if len(rest) else (rank[:0], rank[:0])
        at, ids = np.concatenate([rest[piece], whole]), np.concatenate([token, rank[whole]])
        return ids[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(new)).astype(np.int64)

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of the lists of ids with these bounds."""
        doc, pos = _places(np.diff(at))
        got, out = self.ask(_DECODE, "ids", {"doc": doc, "pos": pos, "id": ids}), [b""] * (len(at) - 1)
        for d, t in zip(got["doc"].tolist(), got["text"].tolist(), strict=True):
            out[d] = t.encode("latin-1")
        return out


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the list, and place in it, of each member of lists of some sizes."""
    n = int(sizes.sum())
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


class Coder:
    """Encodes and decodes texts; keeps the pieces that it has seen, up to ``KNOWN``."""

    def __init__(self, path: str, pattern: str):
        self.cut, self.tables = regex.compile(pattern), Tables(load_ranks(path))
        self.pieces = Lexicon(self.tables.encoded, KNOWN)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and their bounds."""
        split = [self.cut.findall(t) if t else [] for t in texts]
        pieces = {p: p.encode(errors="surrogatepass") for p in set().union(*split)}
        self.pieces.add(set(pieces.values()))
        number = {p: self.pieces.number[e] for p, e in pieces.items()}
        sizes = np.array([len(x) for x in split])
        ids, n = self.pieces.ids(np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum())))
        return ids, np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of the lists of ids with these bounds."""
        return [x for lo, hi in slices(np.diff(at).tolist(), DECODED) for x in self.tables.decoded(ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])]


def _coder(path: str, pattern: str) -> Coder:
    return kept(("coder", path, pattern), lambda: Coder(path, pattern))


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",), text: str = "text", back: bool = False) -> DataFrame:
    """The columns in ``keep`` and ids (array of int) of every row; with ``back`` the bytes that they decode to as ``decoded``."""
    names = [*(f"_k{i}" for i in range(len(keep))), "ids", *(["decoded"] if back else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for b in batches:
            column = b.column(len(keep))
            for lo, hi in slices([len(t or "") for t in column.to_pylist()], CUT):
                ids, at = coder.encode(column.slice(lo, hi - lo).to_pylist())
                own = [*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*own, *([pa.array(coder.decode(ids, at), pa.binary())] if back else [])], names)

    small_batches(docs.sparkSession)
    rows = docs.select(*[docs[k].alias(n) for k, n in zip(keep, names)], docs[text].cast("string").alias("_text"))
    made = rows.mapInArrow(run, ", ".join(filter(None, [_kinds(rows.drop("_text")), "ids array<int>", "decoded binary" if back else ""])))
    return made.select(*[made[n].alias(k) for k, n in zip(keep, names)], *names[len(keep) :])


def decode(encoded: DataFrame, path: str, pattern: str = "") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids."""
    names = encoded.columns
    at_ids = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for b in batches:
            lists = b.column(at_ids)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(coder.decode(ids, at), pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, f"{_kinds(encoded)}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    out = encode(docs, path, pattern, back=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.encode(ids, "utf-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
