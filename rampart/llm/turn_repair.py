"""Conversation structure repair: a min-plus matrix for each turn, multiplied along conversations in a tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

#: States while reading role initials: nothing yet, after s, after u, after a. A conversation ends in ENDS.
STATES, ENDS = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
RENAME, DELETE, INSERT, OPEN_END = 2, 3, 2, 1
#: What a row is to the matrices: its role's initial, in upper case if truncated; OTHER for any further initial; GONE must go.
OTHER, GONE = "o", "x"
#: Letters of which a product is kept by their text, and letters multiplied at once by a stream of rows.
LEAF, CHUNK = 8, 1 << 16
#: Products of so many segments of a conversation are multiplied by one task.
FAN = 16

#: An element is (cost, audit), or None where there is no way; a matrix is a tuple of STATES * STATES.
Matrix = tuple


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: the cheapest way through any middle state, of equal ones the least audit.

    Two ways over the same rows of equal cost have audits of which neither begins the other (what follows
    could only be inserts, which cost), so what is less stays less whatever comes behind: the product is
    associative, and products may be taken in any tree.
    """
    out = []
    for i in range(0, 16, 4):
        row = [(k, x) for k, x in enumerate(a[i : i + 4]) if x]
        for j in range(4):
            best = None
            for k, x in row:
                y = b[4 * k + j]
                if y:
                    cost = x[0] + y[0]
                    if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                        best = cost, x[1] + y[1]
            out.append(best)
    return tuple(out)


def _matrix(ways: Iterable[tuple[int, int, int, str]]) -> Matrix:
    out: list = [None] * (STATES * STATES)
    for i, j, cost, audit in ways:
        if out[4 * i + j] is None or (cost, audit) < out[4 * i + j]:
            out[4 * i + j] = cost, audit
    return tuple(out)


ONE = _matrix((i, i, 0, "") for i in range(STATES))


@lru_cache(1)
def inserts() -> Matrix:
    """The closure of inserting a user's or an assistant's turn: no, one or more of them."""
    once = _matrix([*((i, i, 0, "") for i in range(STATES)), *((i, j, INSERT, "I") for (i, role), j in STEP.items() if role in "ua")])
    return times(times(once, once), times(once, once))


@lru_cache(64)
def turn(letter: str) -> Matrix:
    """The edits of one row, then any inserts."""
    ways = [(i, i, DELETE, "D") for i in range(STATES)]
    if letter != GONE:
        late = OPEN_END * letter.isupper()
        for (i, role), j in STEP.items():
            if role == letter.lower():
                ways.append((i, j, late, "K"))
            if role in "ua":
                ways.append((i, j, RENAME + late, "R"))
    return times(_matrix(ways), inserts())


@lru_cache(1 << 15)
def _leaf(letters: str) -> Matrix:
    out = turn(letters[0])
    for x in letters[1:]:
        out = times(out, turn(x))
    return out


def product(letters: str) -> Matrix:
    """The matrices of all letters multiplied in a tree; short runs of letters are kept."""
    if not letters:
        return ONE
    level = [_leaf(letters[k : k + LEAF]) for k in range(0, len(letters), LEAF)]
    while len(level) > 1:
        level = [times(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def cheapest(rows: Matrix) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a whole conversation."""
    whole = times(inserts(), rows)
    return min(whole[j] for j in ENDS if whole[j])


class Segment:
    """What adjoining rows of a conversation come to; two of them, one after the other, come to one."""

    def __init__(self):
        self.letters, self.waiting, self.done = [], 0, ONE
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn_no: int | None, initial: str, n: int, blank: bool, seen: bool, truncated: bool) -> None:
        """n equal rows of one turn; ``seen`` if such a row came in an earlier turn."""
        again = n if seen else n - 1
        if blank:
            self.blank += n
            told = GONE * n
        else:
            letter = initial if initial in ("s", "u", "a") else OTHER
            self.duplicate += again
            self.truncated += truncated and not seen
            told = GONE * again if seen else (letter.upper() if truncated else letter) + GONE * again
        self.letters.append(told)
        self.waiting += n
        if self.waiting >= CHUNK:
            self.fold()
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn_no is not None:
            self.turns += turn_no != self.high or self.low is None
            self.low, self.high = turn_no if self.low is None else self.low, turn_no

    def fold(self) -> Matrix:
        if self.waiting:
            self.done = times(self.done, product("".join(self.letters))) if self.done is not ONE else product("".join(self.letters))
            self.letters, self.waiting = [], 0
        return self.done

    def then(self, x: Segment) -> Segment:
        self.illegal += x.illegal + (self.last + x.first not in ("su", "ua", "au"))
        self.last = x.last
        self.turns += x.turns - (self.high is not None and self.high == x.low)
        self.low, self.high = x.low if self.low is None else self.low, self.high if x.high is None else x.high
        for c in ("blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + getattr(x, c))
        self.done = times(self.fold(), x.fold())
        return self

    def figures(self) -> tuple:
        cost, audit = cheapest(self.fold())
        return (0 if self.low is None else self.high - self.low + 1 - self.turns), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: A segment as a row; ``figures`` are there if the conversation is whole, else what the matrix and its ends hold.
SEGMENT = f"conv_id long, seg long, figures struct<{FIGURES.replace(' ', ': ').replace(',:', ',')}>, costs array<long>, audits array<string>, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")
_PLAIN = ("first", "last", "low", "high", *_COUNTS)
_FIGURES = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in FIGURES.split(", ")])
_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("seg", pa.int64()), ("figures", _FIGURES), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), *((c, pa.int64()) for c in _COUNTS)]
)


def _row(conv_id: int | None, seg: int, x: Segment, whole: bool) -> dict:
    if whole:
        return {"conv_id": conv_id, "seg": seg, "figures": dict(zip(_FIGURES.names, x.figures(), strict=True))}
    ways = x.fold()
    return {"conv_id": conv_id, "seg": seg, "costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways]} | {c: getattr(x, c) for c in _PLAIN}


def _segment(row: dict) -> Segment:
    x = Segment()
    x.done = tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True))
    for c in _PLAIN:
        setattr(x, c, row[c])
    return x


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SEGMENT], schema=_SEGMENT)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of a task's rows; only its first and its last conversation may go on in other tasks."""
    seg, now, at, begun, out = TaskContext.get().partitionId(), None, None, 0, []
    for batch in batches:
        for conv_id, *told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != at:
                if now:
                    out.append(_row(at, seg, now, begun > 1))
                now, at, begun = Segment(), conv_id, begun + 1
            now.add(*told)
        if len(out) >= 1000:
            yield _batch(out)
            out = []
    if now:
        out.append(_row(at, seg, now, False))
    if out:
        yield _batch(out)


def _joined(last: bool):
    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        level = [_segment(r) for r in rows]
        while len(level) > 1:
            level = [level[k].then(level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return pa.Table.from_batches([_batch([_row(rows[0]["conv_id"], rows[0]["seg"], level[0], last)])])

    return join


def _body(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _runs(turns: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with their number n; texts by their MD5."""
    end = F.right(_body(F.col("text")), F.lit(1))
    told = turns.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "copies", (end == "").alias("blank"), (~end.isin(*".!?")).alias("truncated"))
    return told.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))


def figures(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation with rows.

    turns: conv_id, turn, role, text, copies (``damaged`` gives them). Rows are ordered by turn, nulls first,
    then by role and the text's MD5. They are ranged over tasks in that order, so that even one conversation
    with most of the rows is cut; a task multiplies the matrices of each conversation's rows, and what the
    first and the last of its conversations come to is multiplied further in groups of FAN, by levels whose
    number is the logarithm of the number of tasks.
    """
    spark = turns.sparkSession
    runs = stored(_runs(turns), "runs")
    text = ["conv_id", "role", "digest"]
    often = runs.groupBy(*text).agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn")).alias("least"), F.count("*").alias("times")).where("times > 1")
    often = often.select(*(F.col(c).alias(f"_{c}") for c in text), F.col("least.turn").alias("_turn"), F.lit(True).alias("_often"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in text]
    seen = F.col("_often").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    marked = stored(runs.join(often, same, "left").select("conv_id", "turn", "role", "digest", "n", "blank", seen.alias("seen"), "truncated"), "marked")
    key = ["conv_id", "turn", "role", "digest"]
    ranged = marked.repartitionByRange(*key).sortWithinPartitions(*key)
    parts = stored(ranged.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "blank", "seen", "truncated").mapInArrow(_scan, SEGMENT), "segments")
    open_, tasks = parts.where("figures is null"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, (parts.agg(F.max("seg")).first()[0] or 0) + 1)
    width = 1
    while width < tasks or width == 1:
        width *= FAN
        open_ = open_.groupBy("conv_id", F.floor(F.col("seg") / width).alias("_group")).applyInArrow(_joined(width >= tasks), SEGMENT)
    return parts.where("figures is not null").unionAll(open_).select("conv_id", "figures.*")


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
#: The state before a turn and the role that is missing there.
_MISSING = {0: "user", 1: "user", 2: "assistant", 3: "user"}


class _Repair:
    """Applies a conversation's audit to its rows in order."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state, self.place = conv_id, audit, 0, 0, 0

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.state, self.place = STEP[self.state, role[0]], self.place + 1
        return self.conv_id, self.place - 1, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put("I", _MISSING[self.state], "")

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._put(edit, role if edit == "K" else _MISSING[self.state], text)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Repair | None = None
    for batch in batches:
        out: list[tuple] = []
        for conv_id, audit, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                out.extend(now.inserted() if now else ())
                now = _Repair(conv_id, audit)
            else:
                out.extend(now.row(role, text, copies))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_REPAIRED)], schema=_REPAIRED)
    if now and (out := list(now.inserted())):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_REPAIRED)], schema=_REPAIRED)


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the turns of every repaired conversation, each conversation's in order in one task.

    audits: conv_id, audit, of all conversations of ``turns``. A conversation's audit goes before its rows,
    and both are streamed, so that memory holds a batch and an audit.
    """
    head = audits.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.lit("").alias("digest"))
    rows = turns.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", F.md5("text").alias("digest"))
    both = head.unionAll(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_repair, "conv_id long, place long, edit string, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, now = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([now.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if now:
                    yield row()
                at, now = conv_id, hashlib.sha256()
            now.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if now:
        yield row()


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the rows of ``repaired``: of `role:text`, joined by newlines."""
    return rows.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def turns_of(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of a table of turns; null roles and texts are one space."""
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def damaged(table: DataFrame) -> DataFrame:
    """The turns, damaged by crc32(`conv_id:turn`) % 20, null ids as one space: 0 goes, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 is the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    told = turns_of(table).withColumn("_h", F.crc32(name) % 20).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return told.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_h") == 3, 2).otherwise(1).alias("copies"))


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Every conversation's faults, the cheapest repair and the digest of what it gives.

    turns: conv_id, turn, role, text, copies; every: conv_id, conversations to be listed even without rows
    (zeros, empty audit, the hash of nothing). Null ids are one conversation; null turns come first; rows
    tied in a turn are ordered by role and the text's MD5, equal rows stay side by side and all but the first
    are duplicates; null roles and texts are one space, and a role whose initial is not s, u or a (an empty
    one too) can't be kept as it is; very long texts are hashed by tasks, and only rows of the repaired
    conversations carry them; further columns, whatever their names, are ignored; an empty table gives an
    empty result. The digest needs a conversation's turns in sequence: one task streams them.
    """
    told = stored(figures(turns), "figures")
    found = told.join(stored(digests(repaired(turns, told)), "repaired").withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    if every is not None:
        ids = every.select(F.col("conv_id").cast("long").alias("_id")).distinct()
        found = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").withColumn("conv_id", F.col("_id")).drop("_id")
    counts = [c for c in _FIGURES.names if c != "audit"]
    return found.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of all conversations after the contract's damage."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(table), table)


def _sql_way(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"


def _sql_least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _sql_edit(j: int) -> str:
    """The cheapest way to state j by one row, told as g (gone), t (1 if truncated) and i (initial)."""
    by = [_sql_way(f"s{j}", "3", "D")]
    for (i, role), to in STEP.items():
        if to == j:
            by.append(_sql_way(f"s{i}", f"CASE WHEN g OR i <> '{role}' THEN 1000000000 ELSE t END", "K"))
            by += [_sql_way(f"s{i}", "CASE WHEN g THEN 1000000000 ELSE 2 + t END", "R")] if role in "ua" else []
    return _sql_least(*by)


#: The CRC is folded byte by byte over a table that the query makes; the states go row by row, not by matrices.
ORACLE_OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda b: ord(b)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(x, '.', ''), '!', ''), '?', '') ELSE x END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), rows_ AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS li, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup FROM placed
), faults AS (
  SELECT *, blank OR dup AS g, (NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?'))::BIGINT AS t FROM rows_
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, sum(t) AS truncated, count(*) FILTER (li IS NOT NULL AND li || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 2::BIGINT, 'a': 'I'}} AS s2, {{'c': 4::BIGINT, 'a': 'II'}} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, k, s0, s1, {_sql_least("s2", _sql_way("s0", "2", "I"), _sql_way("s1", "2", "I"), _sql_way("s3", "2", "I"))}, {_sql_least("s3", _sql_way("s2", "2", "I"), _sql_way("s0", "4", "II"), _sql_way("s1", "4", "II"))}
  FROM (SELECT d.conv_id, d.k + 1 AS k, {", ".join(f"{_sql_edit(j)} AS s{j}" for j in range(STATES))} FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.k = d.k + 1)
), audits AS (
  SELECT c.*, list_min([s0, s3]).c AS cost, list_min([s0, s3]).a AS audit FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.k
), edits AS (
  SELECT *, sum((e <> 'I')::BIGINT) OVER (PARTITION BY conv_id ORDER BY p) AS k FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM audits WHERE audit <> '')
), kept AS (
  SELECT e.conv_id, e, p, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) - first_value((e = 'K' AND f.i = 's')::BIGINT) OVER (PARTITION BY e.conv_id ORDER BY p) AS place
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k AND e <> 'I' WHERE e <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS h FROM kept GROUP BY conv_id
)
SELECT i.conv_id, {", ".join(f"coalesce(a.{c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))}, coalesce(a.audit, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""
