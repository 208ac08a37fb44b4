r"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Each partition holds an in-process DuckDB with the merge table (left id, right id, merged id; a merge's
rank is its id) and the vocabulary. The distinct pieces of a run of texts become token-position rows,
one per byte; a recursive query joins neighbouring rows with the merge table and contracts each
piece's leftmost pair of least rank until no pair of the piece merges. As a recursive query keeps the rows
of all its rounds, it stops after so many that these are at most ``ROWS`` and goes on from its last round
alone, in memory that grows with the longest piece, not with its rounds; beyond that DuckDB spills. Decoding joins ids with the
vocabulary and concatenates in order of position. The ids of each distinct piece, one or many, are so
decoded; those of a text decode to its pieces' bytes in order. Pieces seen before come from a bounded memo,
where a piece is found, too, that was a chunk of its own.

Texts are first cut into chunks (an optional space and a run of non-space, or white space), a cut that
every match of the tokenizer pattern respects, so that the pattern runs once per distinct chunk.

Defined cases: a null text encodes as the empty text (no ids, decodes to nothing); special tokens are
ordinary text; an empty table gives no rows; repeated rows repeat; columns beside id and text are
ignored. Texts are whole however long; memory holds one run of texts (``RUN_CHARS``, a part of it, or one text).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_CHARS = 6_000_000  #: characters of text whose new pieces go to one recursive query
PIECES = 60_000  #: pieces in one recursive query
LONG = 64  #: bytes of a piece beyond which pairs that don't depend on each other are contracted together
LONG_RUN = 100_000  #: bytes of long pieces in one recursive query, or one piece
ROWS = 5_000_000  #: rows that a recursive query makes before it starts anew from its last round, or one round
CROSSINGS = 16  #: crossings a byte of a long piece (see ENCODE_LONG) beyond which they aren't used
MEMORY, PIECE_MEMORY = 300_000_000, 1_000  #: bytes of memory of DuckDB, and those for each byte of a long piece; then it spills
MEMO = 900_000  #: chunks kept from earlier runs, some 300 bytes each; fewer take less memory and more time
#: White space as the pattern's \s has it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

NEVER = 1 << 30  #: over any rank

# A row is a token: g = piece << 32 | position of its first byte. A pair's key is its rank, then its position.
#
# Each round contracts a piece's leftmost pair of least rank, and with it every pair that is bound to merge as it
# stands, whatever happens around it: (a, b) of rank r is, if nothing can take a or b from it before its turn. What
# takes a is a merge with a on its right and, on its left, a token that ends with the one before a now; ``low`` of the
# pair (before, a) is the least rank of such merges, and has to be over r. What takes b is a merge with b on its left
# and, on its right, a token that begins with the one after b now; ``high`` of (b, after) is the least rank of these and
# must not be under r (at equal rank the left one goes first). The new token must not merge on at a rank below its own,
# or it would do so too early; ``firm`` is r where it doesn't. Two such pairs never share a token, nor does one with the
# leftmost of least rank. Rows of a piece without a pair that merges go out once more, with a negative round.
ENCODE = f"""
WITH RECURSIVE step(g, tok, round) AS (
  SELECT g, tok, 0 FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT n.g, n.tok, n.round, m.merged, coalesce(m.firm, {NEVER}) AS firm, coalesce(m.low, {NEVER}) AS low, coalesce(m.high, {NEVER}) AS high,
            (m.merged::BIGINT << 32) + (n.g & 4294967295) AS key
     FROM (SELECT g, tok, round, CASE WHEN (lead(g) OVER w) >> 32 = g >> 32 THEN (tok::BIGINT << 20) + lead(tok) OVER w END AS pair
           FROM step WHERE round BETWEEN 0 AND $rounds - 1 WINDOW w AS (ORDER BY g)) n
     LEFT JOIN merges m ON m.pair = n.pair),
   least AS (SELECT g >> 32 AS piece, min(key) AS best FROM pairs WHERE merged IS NOT NULL GROUP BY piece),
   due AS (SELECT p.g, p.tok, p.merged, p.high, p.low, CASE WHEN p.key = l.best THEN -1 ELSE p.firm END AS rank, CASE WHEN l.best IS NULL THEN -1 ELSE p.round + 1 END AS round
           FROM pairs p LEFT JOIN least l ON l.piece = p.g >> 32),
   near AS (SELECT g, tok, merged, round, rank, high, lead(high, 1, {NEVER}) OVER w AS after, lag(low, 1, {NEVER}) OVER w AS before,
                   lag(rank, 1, {NEVER}) OVER w AS left_rank, lag(low, 2, {NEVER}) OVER w AS left_before
            FROM due WINDOW w AS (ORDER BY g))
   SELECT g, CASE WHEN before > rank AND after >= rank THEN merged ELSE tok END AS tok, round
   FROM near WHERE NOT (left_before > left_rank AND high >= left_rank)))
SELECT * FROM step WHERE round < 0 OR round = $rounds
"""

# The same for long pieces, where one round contracts every occurrence of the least pair, leftmost first; in a
# run of one token that is every other pair. Where a token can merge on at a rank below its own (not firm),
# another occurrence might not come next, and only the leftmost is contracted. Beside these, a round contracts each
# pair that is bound to merge as it stands, by the text around it and not by one token alone: the only steps that could take a token of it before its turn make a token
# of lower rank (of equal rank, to its left) that crosses an outer edge of the pair. ``crossings`` has a row for each
# place (s to e) of a vocabulary token in the pieces and each position inside it; a place counts while its ends and
# that position are edges of tokens.
ENCODE_LONG = """
WITH RECURSIVE step(g, tok, round) AS (
  SELECT g, tok, 0 FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT n.g, n.tok, n.round, n.rn, n.past, m.merged, m.firm IS NOT NULL AS safe, (m.merged::BIGINT << 32) + (n.g & 4294967295) AS key
     FROM (SELECT g, tok, round, row_number() OVER (ORDER BY g) AS rn, lead(g, 2) OVER (ORDER BY g) AS past,
                  CASE WHEN (lead(g) OVER (ORDER BY g)) >> 32 = g >> 32
                  THEN (tok::BIGINT << 20) + lead(tok) OVER (ORDER BY g) END AS pair FROM step WHERE round BETWEEN 0 AND $rounds - 1) n
     LEFT JOIN merges m ON m.pair = n.pair),
   least AS (SELECT g >> 32 AS piece, min(key) AS best FROM pairs WHERE key IS NOT NULL GROUP BY piece),
   alike AS (SELECT p.*, l.best, coalesce(p.merged = l.best >> 32, false) AS same FROM pairs p LEFT JOIN least l ON l.piece = p.g >> 32),
   runs AS (SELECT *, same AND NOT coalesce(lag(same) OVER (ORDER BY g), false) AS first FROM alike),
   edges AS MATERIALIZED (SELECT g FROM pairs UNION ALL SELECT g FROM ends),
   live AS MATERIALIZED (SELECT edge, min(rank) AS rank FROM crossings
                         WHERE s IN (SELECT g FROM edges) AND edge IN (SELECT g FROM edges) AND e IN (SELECT g FROM edges) GROUP BY edge),
   bound AS (SELECT r.*, $free AND merged IS NOT NULL AND coalesce(a.rank > merged, true) AND coalesce(b.rank >= merged, true) AS bound
             FROM runs r LEFT JOIN live a ON a.edge = r.g LEFT JOIN live b ON b.edge = r.past),
   hits AS (SELECT *, bound OR coalesce(same AND (safe OR key = best)
                   AND (rn - max(CASE WHEN first THEN rn END) OVER (ORDER BY g)) % 2 = 0, false) AS hit FROM bound)
   SELECT g, tok, round
   FROM (SELECT g, CASE WHEN best IS NULL THEN -1 ELSE round + 1 END AS round, CASE WHEN hit THEN merged ELSE tok END AS tok,
                coalesce(lag(hit) OVER (ORDER BY g), false) AS gone FROM hits)
   WHERE NOT gone))
SELECT * FROM step WHERE round < 0 OR round = $rounds
"""

#: The tokens of the pieces that have come to their end, in order: id and a space, and what the id decodes to.
FINISH = """
SELECT s.g >> 32 AS piece, s.tok || ' ' AS ids, unhex(v.hex) AS bytes
FROM steps s JOIN vocabulary v ON v.id = s.tok WHERE s.round < 0 ORDER BY s.g
"""

DECODE = """
SELECT seq, array_to_string(hex, '') AS hex
FROM (SELECT i.seq, list(v.hex ORDER BY i.pos) AS hex FROM ids i JOIN vocabulary v ON v.id = i.id GROUP BY i.seq)
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """pair (left id << 20 | right id) -> merged, firm, low, high (see ENCODE), null where there is none."""
    splits = [(t[:i], t[i:], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    unsafe = {ranks[x] for a, b, r in splits for x in (a, b) if r < ranks[x]}
    merged, low, high = {}, {}, {}
    for a, b, r in splits:
        left, right = ranks[a], ranks[b]
        merged[(left << 20) + right] = r
        for i in range(len(a)):
            if (end := ranks.get(a[i:])) is not None and low.get(key := (end << 20) + right, r) >= r:
                low[key] = r
        for i in range(1, len(b) + 1):
            if (begin := ranks.get(b[:i])) is not None and high.get(key := (left << 20) + begin, r) >= r:
                high[key] = r
    keys = list(low.keys() | high.keys())  # those of ``merged`` among them
    column = lambda of: pa.array(map(of.get, keys), pa.int32())
    firm = {k: r for k, r in merged.items() if r not in unsafe}
    return pa.table({"pair": pa.array(keys, pa.int64()), "merged": column(merged), "firm": column(firm), "low": column(low), "high": column(high)})


def joined(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """The values of a column one after another, and where each begins and the last ends."""
    values = pa.concat_arrays(c.cast(pa.large_binary()) for c in column.chunks)
    _, at, data = values.buffers()
    return data.to_pybytes(), np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]


class Codec:
    """Encoder and decoder of one worker process, over one rank file."""

    _made: dict[tuple, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": f"{tempfile.gettempdir()}/bpe-{os.getpid()}"})
        self.con.execute("SET enable_progress_bar = false")
        self._table("merges", merge_table(ranks))
        self._table("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}))
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.prefixes: set[bytes] = set()  # those of the vocabulary, once a long piece is met
        self.part = 1  #: runs of texts, queries and their rows are so many times smaller: less memory, more time
        self.pattern, self.chunk, self.double = regex.compile(pattern), re.compile(CHUNK), re.compile(f"[{SPACE}][{SPACE}]")
        #: chunk -> its ids joined by a space, their bytes; in ``spaced`` a chunk stands without the space before it.
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.spaced_ids: dict[str, str] = {}
        self.spaced_bytes: dict[str, bytes] = {}

    @classmethod
    def get(cls, content: bytes, pattern: str) -> Codec:
        key = (hashlib.sha256(content).digest(), pattern)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(read_ranks(content), pattern)
        return cls._made[key]

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        """Joined ids of each piece and the bytes that these decode to; a piece that is a token is found whole, as tiktoken does."""
        out: list = [None] * len(pieces)
        whole = [i for i, p in enumerate(pieces) if p in self.ranks]
        for i, text in zip(whole, self.decode_lists([[self.ranks[pieces[i]]] for i in whole]), strict=True):
            out[i] = (str(self.ranks[pieces[i]]), text)
        todo = [i for i, p in enumerate(pieces) if p not in self.ranks]
        short = [i for i in todo if len(pieces[i]) <= LONG]
        step, most = max(1, PIECES // self.part), LONG_RUN // self.part
        runs = [(ENCODE, short[at : at + step]) for at in range(0, len(short), step)]
        n = most
        for i in (i for i in todo if len(pieces[i]) > LONG):
            if n + len(pieces[i]) > most:
                runs.append((ENCODE_LONG, []))
                n = 0
            runs[-1][1].append(i)
            n += len(pieces[i])
        for query, part in runs:
            sizes = np.array([len(pieces[i]) for i in part])
            data = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            self._table("start", pa.table({"g": (np.repeat(np.arange(len(part), dtype=np.int64), sizes) << 32) + np.arange(len(data)) - starts, "tok": self.of_byte[data]}))
            free = query is ENCODE_LONG and self._crossings([pieces[i] for i in part])
            if more := max(0, len(data) - LONG_RUN) * PIECE_MEMORY:
                self.con.execute(f"SET memory_limit = '{MEMORY + more}B'")
            n = len(data)
            while n:  # a run of rounds after another, each from the last round of the one before
                rounds = max(1, ROWS // self.part // n)
                fill = lambda x: x.replace("$rounds", str(rounds)).replace("$free", str(free))  # noqa: B023, E731
                self.con.execute(f"CREATE OR REPLACE TABLE steps AS {fill(query)}")
                got = self.con.sql(fill(FINISH)).to_arrow_table()
                if got.num_rows:
                    piece = got["piece"].to_numpy()
                    first = np.flatnonzero(np.diff(piece, prepend=-1))
                    (ids, ids_at), (text, text_at) = joined(got["ids"]), joined(got["bytes"])
                    cuts = [at[np.append(first, len(piece))].tolist() for at in (ids_at, text_at)]
                    ids = ids.decode()
                    for k, i in enumerate(piece[first].tolist()):
                        out[part[i]] = (ids[cuts[0][k] : cuts[0][k + 1] - 1], text[cuts[1][k] : cuts[1][k + 1]])
                self.con.execute(f"CREATE OR REPLACE TABLE start AS SELECT g, tok FROM steps WHERE round = {rounds}")
                n = self.con.sql("SELECT count(*) AS n FROM start").to_arrow_table()["n"][0].as_py()
            if more:
                self.con.execute("DROP TABLE steps")
                self.con.execute("DROP TABLE IF EXISTS crossings")
                self.con.execute(f"SET memory_limit = '{MEMORY}B'")
        self.con.sql("DROP TABLE IF EXISTS steps")
        return out

    def _crossings(self, pieces: list[bytes]) -> bool:
        """Makes the tables crossings and ends of the pieces; False, and they are empty, if there are too many of them."""
        if not self.prefixes:
            self.prefixes.update(t[:n] for t in self.ranks for n in range(2, len(t) + 1))
        ranks, prefixes = self.ranks, self.prefixes
        s, e, rank = array("q"), array("q"), array("q")
        left = CROSSINGS * sum(map(len, pieces))
        for i, piece in enumerate(pieces):
            base = i << 32
            for at in range(len(piece)):
                end = at + 2
                while end <= len(piece) and (t := piece[at:end]) in prefixes:
                    if t in ranks:
                        s.append(base + at)
                        e.append(base + end)
                        rank.append(ranks[t])
                        left -= end - at - 1
                    end += 1
                if left < 0:
                    break
        free = left >= 0
        cut = slice(None if free else 0)
        self._table("places", pa.table({"s": np.array(s, np.int64)[cut], "e": np.array(e, np.int64)[cut], "rank": np.array(rank, np.int64)[cut]}))
        self.con.execute("CREATE OR REPLACE TABLE crossings AS SELECT s, e, rank, unnest(range(s + 1, e)) AS edge FROM places")
        self.con.execute("DROP TABLE places")
        self._table("ends", pa.table({"g": np.array([(i << 32) + len(p) for i, p in enumerate(pieces)], np.int64)}))
        return free

    def decode_lists(self, lists: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids, by an ordered aggregation over token-position rows."""
        out = [b""] * len(lists)
        step = max(1, 4 * PIECES // self.part)
        for at in range(0, len(lists), step):
            part = lists[at : at + step]
            sizes = np.array([len(x) for x in part])
            flat = np.fromiter((i for x in part for i in x), np.int32, int(sizes.sum()))
            self._table("ids", pa.table({"seq": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
            got = self.con.sql(DECODE).to_arrow_table()
            for seq, text in zip(got["seq"].to_pylist(), got["hex"].to_pylist(), strict=True):
                out[at + seq] = bytes.fromhex(text)
        return out

    def parts(self, text: str) -> tuple[list[str], list[str]] | None:
        """First chunks of the lines, and all chunks after a space; None where white space stands together."""
        if self.double.search(text):
            return None
        firsts, spaced = [], []
        for line in text.split("\n"):
            words = line.split(" ")
            firsts.append(words[0])
            spaced += words[1:]
        return firsts, spaced

    def remembered(self, piece: str) -> tuple[str, bytes] | None:
        """What the memo has of a piece that was a chunk of its own."""
        for ids, bytes_, key in ((self.ids, self.bytes, piece), *([(self.spaced_ids, self.spaced_bytes, piece[1:])] * (piece[0] == " "))):
            if key in ids and self.pattern.match(piece).end() == len(piece):
                return ids[key], bytes_[key]
        return None

    def learn(self, texts: list[str], most: int) -> None:
        """Puts every chunk of the texts into the memo, which is emptied first if it holds over ``most``."""
        if len(self.ids) + len(self.spaced_ids) > most:
            for memo in (self.ids, self.bytes, self.spaced_ids, self.spaced_bytes):
                memo.clear()
        new, new_spaced = {"\n"}, set()
        for t in texts:
            if found := self.parts(t):
                new.update(found[0])
                new_spaced.update(found[1])
            else:
                new.update(self.chunk.findall(t))
        new.difference_update(self.ids)
        new_spaced.difference_update(self.spaced_ids)
        split = {c: self.pattern.findall(c) for c in new}
        spaced = {c: self.pattern.findall(" " + c) for c in new_spaced}
        known = {p: self.remembered(p) for of in (split, spaced) for ps in of.values() for p in ps}
        todo = [p for p, found in known.items() if not found]
        known |= zip(todo, self.encode_pieces([p.encode() for p in todo]), strict=True)
        for of, ids, bytes_ in ((split, self.ids, self.bytes), (spaced, self.spaced_ids, self.spaced_bytes)):
            for c, ps in of.items():
                if len(ps) == 1:
                    ids[c], bytes_[c] = known[ps[0]]
                else:
                    ids[c], bytes_[c] = " ".join([known[p][0] for p in ps]), b"".join([known[p][1] for p in ps])

    def run(self, text: str) -> tuple[str, bytes]:
        """Ids of a learnt text, joined by a space, and the bytes that they decode to."""
        if self.double.search(text):
            chunks = self.chunk.findall(text)
            return " ".join(map(self.ids.__getitem__, chunks)), b"".join(map(self.bytes.__getitem__, chunks))
        ids, out = [], []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                ids.append(self.ids["\n"])
                out.append(self.bytes["\n"])
            if first := words.pop(0):
                ids.append(self.ids[first])
                out.append(self.bytes[first])
            ids += map(self.spaced_ids.__getitem__, words)
            out += map(self.spaced_bytes.__getitem__, words)
        return " ".join(ids), b"".join(out)


def runs(texts: pa.Array, part: int = 1) -> Iterator[list[str]]:
    """The texts in runs of RUN_CHARS, or a part of that; null as the empty text."""
    run: list[str] = []
    n = 0
    for t in texts:
        run.append(t.as_py() or "")
        n += len(run[-1])
        if n >= RUN_CHARS // part:
            yield run
            run, n = [], 0
    if run:
        yield run


def encode(docs: DataFrame, content: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, lists: bool = True, memo: int = MEMO, part: int = 1) -> DataFrame:
    """id, n_tokens and, with ``lists``, ids (array<int>) and, with ``digests``, the SHA-256 of the joined ids and of the decoded bytes.

    Neither ``memo`` nor ``part`` (see Codec) changes a result, only the memory and time that it takes.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = [("ids", "array<int>", pa.list_(pa.int32()))] * lists + [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] * digests
    schema = f"`{id_col}` {id_type}, n_tokens long, " + ", ".join(f"{name} {kind}" for name, kind, _ in extra)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        codec = Codec.get(content, pattern)
        codec.part = part
        for batch in batches:
            at = 0
            for run in runs(batch.column(1), part):  # a batch out for each run, so that only one is held
                codec.learn(run, memo)
                n, cols = [], [[] for _ in extra]
                for text in run:
                    ids, decoded = codec.run(text)
                    n.append(ids.count(" ") + 1 if ids else 0)
                    if lists:
                        cols[0].append(np.array(ids.split(), np.int32))
                    if digests:
                        cols[-2].append(hashlib.sha256(ids.encode()).hexdigest())
                        cols[-1].append(hashlib.sha256(decoded).hexdigest())
                arrays = [pa.array(c, kind) for c, (*_, kind) in zip(cols, extra, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), pa.array(n, pa.int64()), *arrays], names=[id_col, "n_tokens", *(name for name, *_ in extra)])
                at += len(run)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def decode(rows: DataFrame, content: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded (binary); null ids decode to nothing."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(content, pattern)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode_lists(lists), pa.binary())], names=[id_col, "decoded"])

    return rows.select(F.col(id_col), F.col(ids_col)).mapInArrow(work, f"`{id_col}` {id_type}, decoded binary")
