"""Repair of the turn structure of conversations at the least cost.

The rows of a conversation, in order, are steps through a small graph: its
states say which role came last, its edges insert rows and then keep, rerole
or delete the next one. The weight of a path is one integer: its high digits
carry the cost, its low digits the letters of its edits, one digit of fixed
width for each, padded by zeros at the end. The least integer over all paths
is the cheapest repair, ties going to the least string of letters, so that
plain integer minima decide everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: costs of the edits, the letters' digits in ASCII order, the white space
_REROLE, _DELETE, _INSERT, _TRUNCATED = 2, 3, 2, 1
_DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
_WHITE = " \t\n\x0b\x0c\r"
_LETTERS = {n: x for x, n in _DIGITS.items()}
#: bits of one digit, and the letters that one row can take at most (two inserts, one edit)
_BITS, _PER_ROW = 3, 3

# states: nothing yet, a system row, a user row, an assistant row as the last
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("u", _ASSISTANT): _USER, ("a", _USER): _ASSISTANT}
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL_PAIRS = {"su", "ua", "au"}


def _inserted(state: int, n: int) -> tuple[int, list[str]]:
    """State after ``n`` inserted rows, and their roles: each state goes on to
    one of user and assistant only."""
    roles = []
    for _ in range(n):
        role = "a" if state == _USER else "u"
        state = _AFTER[role, state]
        roles.append(_ROLES[role])
    return state, roles


def _edges(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, str, int, int, list[str], str | None]]:
    """``(from, letters, to, cost, inserted roles, role)`` of all ways past a
    row; the role is None for a deleted row and '' for a kept one. Three
    inserts in a row are never cheapest: two neighbours among them can go."""
    out = []
    for state, n in product((_START, _SYSTEM, _USER, _ASSISTANT), range(_PER_ROW)):
        at, roles = _inserted(state, n)
        letters, cost = "I" * n, _INSERT * n
        out.append((state, letters + "D", at, cost + _DELETE, roles, None))
        if must_go:
            continue
        late = _TRUNCATED if truncated else 0
        if (initial, at) in _AFTER:
            out.append((state, letters + "K", _AFTER[initial, at], cost + late, roles, ""))
        other = "a" if at == _USER else "u"
        out.append((state, letters + "R", _AFTER[other, at], cost + late + _REROLE, roles, _ROLES[other]))
    return out


def _low(letters: str) -> int:
    n = 0
    for x in letters:
        n = n << _BITS | _DIGITS[x]
    return n


_BLANK, _DUPLICATE, _CUT, _SOUND = "blank", "duplicate", "truncated", ""
_WAYS = {(initial, kind): [(p, len(x), _low(x), q, c, i, r) for p, x, q, c, i, r in
                           _edges(initial, kind in (_BLANK, _DUPLICATE), kind == _CUT)]
         for initial, kind in product(("s", "u", "a", "?"), (_BLANK, _DUPLICATE, _CUT, _SOUND))}


class Repair:
    """One conversation, its rows given in order. Memory holds the letters so
    far of four paths, not the texts: these go into running digests.

    Weights are of ``block_rows`` rows at most. At the end of a block the
    least path to every state is known; paths to different states that end
    with an edit of the same row differ before either ends, so their order
    among themselves is all that later comparisons need: it becomes the first
    digit of the next block's weights.
    """

    def __init__(self, block_rows: int = 512):
        self._block_rows = block_rows
        #: bits of all low digits: the order of the start states, the rows' letters, the inserts at the end
        self._width = _BITS * (1 + _PER_ROW * block_rows + 2)
        self._blocks: list[dict[int, tuple[int, str]]] = []  # state -> (state at the block's start, letters)
        # state -> (weight, digits used, state at the block's start, digest)
        self._paths = {_START: (1 << self._width - _BITS, 1, _START, hashlib.sha256())}
        self._rows = 0

    def row(self, role: str, text: str, kind: str) -> None:
        best: dict[int, tuple] = {}
        width = self._width
        for way in _WAYS[role[:1] if role[:1] in ("s", "u", "a") else "?", kind]:
            path = self._paths.get(way[0])
            if path is None:
                continue
            used = path[1] + way[1]
            weight = path[0] + (way[4] << width) + (way[2] << width - _BITS * used)
            if way[3] not in best or weight < best[way[3]][0]:
                best[way[3]] = (weight, used, path, way)
        paths = {}
        for state, (weight, used, path, (came, _, _, _, _, inserts, new)) in best.items():
            digest = path[3]
            lines = [f"{r}:" for r in inserts]
            if new is not None:
                lines.append(f"{new or role}:{text}")
            if lines:
                digest = self._written(path, lines, came != _START)
            paths[state] = (weight, used, path[2], digest)
        self._paths = paths
        self._rows += 1
        if self._rows % self._block_rows == 0:
            self._close_block()

    @staticmethod
    def _written(path: tuple, lines: list[str], goes_on: bool):
        digest = path[3].copy()
        digest.update((("\n" if goes_on else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return digest

    def _letters(self, path: tuple) -> str:
        low = path[0] & ((1 << self._width) - 1)
        return "".join(_LETTERS[low >> self._width - _BITS * (k + 1) & 7] for k in range(1, path[1]))

    def _close_block(self) -> None:
        mask = (1 << self._width) - 1
        self._blocks.append({state: (path[2], self._letters(path)) for state, path in self._paths.items()})
        order = sorted(self._paths, key=lambda state: self._paths[state][0] & mask)
        self._paths = {state: ((self._paths[state][0] >> self._width << self._width) + (place + 1 << self._width - _BITS),
                               1, state, self._paths[state][3]) for place, state in enumerate(order)}

    def end(self) -> tuple[int, str, str]:
        """``(cost, letters, SHA-256 of the repaired rows)``."""
        ends = []
        for state, path in self._paths.items():
            for n in range(_PER_ROW):
                at, roles = _inserted(state, n)
                if at == _ASSISTANT or at == _START:
                    used = path[1] + n
                    weight = path[0] + (_INSERT * n << self._width) + (_low("I" * n) << self._width - _BITS * used)
                    ends.append((weight, used, state, path, roles))
        weight, used, state, path, roles = min(ends, key=lambda e: e[0])
        digest = self._written(path, [f"{r}:" for r in roles], state != _START) if roles else path[3]
        letters = [self._letters((weight, used))]
        at = path[2]
        for block in reversed(self._blocks):
            at, own = block[at]
            letters.append(own)
        return weight >> self._width, "".join(reversed(letters)), digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage that
    crc32(``conv_id:turn``) % 20 chooses (a null counts as one space there, in
    the role and in the text): 0 drops the row (``gone``; it stays as a mark
    of its conversation), 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it, 4 makes its role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20
    text, role = name("text"), name("role")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (harm == 0).alias("gone"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _kind(again: Column) -> Column:
    """First fault of a row: blank, duplicate, truncated or none."""
    core = F.rtrim(F.col("text"), F.lit(_WHITE))
    return (F.when(core == "", _BLANK).when(again, _DUPLICATE)
            .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), _CUT).otherwise(_SOUND))


_MOST = 2**63 - 1


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation of the table, damaged first.

    Rows are taken by turn (nulls first), equal turns by role and text, so a
    repeated row is next to its copy. Rows with a null ``conv_id`` are one
    conversation with a null id. A role whose first letter is none of s, u, a
    (an empty one too) must be reroled or deleted, and no pair with it is
    legal. Gaps beyond a long are given as the greatest long. Other columns
    are ignored; an empty table gives no rows.

    One shuffle by ``conv_id``; the sort, which spills, brings each
    conversation's rows in order to one pass that holds its letters and never
    its texts, so one long conversation needs no more memory than its row of
    the result. Its digest is of one string and can't be split further.
    """
    rows = damaged(conversations).repartition("conv_id")
    # rows that are alike: within the same partitioning, so not shuffled again
    again = F.expr("row_number() OVER (PARTITION BY conv_id, gone, role, text ORDER BY turn ASC NULLS FIRST)")
    rows = rows.withColumn("_place", again)
    rows = rows.withColumn("_kind", _kind(F.col("_place") > 1))
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_place")
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in columns) + ", audit string, repaired_sha256 string"

    def repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], None
        for batch in batches:
            for conv_id, turn, role, text, gone, kind in zip(*(batch.column(c).to_pylist() for c in
                                                               ("conv_id", "turn", "role", "text", "gone", "_kind"))):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        out.append(state.result())
                    state = _Conversation(conv_id)
                if not gone:
                    state.row(turn, role, text, kind)
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if state is not None:
            out.append(state.result())
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                          ["conv_id", *columns, "audit", "repaired_sha256"])

    return rows.select("conv_id", "turn", "role", "text", "gone", "_kind").mapInArrow(repaired, schema)


class _Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self._repair = Repair()
        self._faults = dict.fromkeys((_BLANK, _DUPLICATE, _CUT, _SOUND), 0)
        self._illegal = 0
        self._last: str | None = None
        self._turns = [0, None, None]  # distinct, least, greatest

    def row(self, turn: int | None, role: str, text: str, kind: str) -> None:
        self._faults[kind] += 1
        if self._last is not None and self._last + role[:1] not in _LEGAL_PAIRS:
            self._illegal += 1
        self._last = role[:1]
        if turn is not None and turn != self._turns[2]:
            least = turn if self._turns[1] is None else self._turns[1]
            self._turns = [self._turns[0] + 1, least, turn]
        self._repair.row(role, text, kind)

    def result(self) -> tuple:
        distinct, least, greatest = self._turns
        gaps = min(greatest - least + 1 - distinct, _MOST) if distinct else 0
        return (self.conv_id, gaps, self._faults[_BLANK], self._faults[_DUPLICATE], self._faults[_CUT], self._illegal,
                *self._repair.end())


#: DuckDB twin of ``repair_conversations(conversations)``: paths are kept whole, cost and letters in columns of their own
ORACLE_SQL = r"""
WITH RECURSIVE
-- CRC-32 by its table: eight shift steps for each byte value
crc AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)) r) t),
named AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS label FROM conversations),
harmed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(label)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM named, crc),
after AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, range(2) WHERE harm <> 0 AND (range = 0 OR harm = 3)),
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM after) x),
steps AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN core = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
-- states: 0 nothing yet, 1 system, 2 user, 3 assistant; rows inserted before the next row
inserts(came, letters, lines, mid) AS (VALUES
  (0, '', [], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', [], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2),
  (3, '', [], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
edits(mid, letter, initial, next, cost, role) AS (VALUES
  (0, 'D', '*', 0, 3, ''), (1, 'D', '*', 1, 3, ''), (2, 'D', '*', 2, 3, ''), (3, 'D', '*', 3, 3, ''),
  (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (3, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''),
  (0, 'R', '*', 2, 2, 'user'), (1, 'R', '*', 2, 2, 'user'), (3, 'R', '*', 2, 2, 'user'), (2, 'R', '*', 3, 2, 'assistant')),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM named
  UNION ALL
  SELECT b.conv_id, s.i, e.next, b.cost + 2 * len(n.letters) + e.cost + CASE WHEN s.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END AS cost,
    b.audit || n.letters || e.letter AS audit,
    list_concat(list_concat(b.lines, CAST(n.lines AS VARCHAR[])),
      CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [s.role || ':' || s.text] ELSE [e.role || ':' || s.text] END) AS lines
  FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 JOIN inserts n ON n.came = b.state
    JOIN edits e ON e.mid = n.mid AND e.initial IN ('*', s.initial) AND (e.letter = 'D' OR s.fault NOT IN ('blank', 'duplicate'))
  QUALIFY ROW_NUMBER() OVER (PARTITION BY b.conv_id, e.next ORDER BY
    b.cost + 2 * len(n.letters) + e.cost + CASE WHEN s.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END, b.audit || n.letters || e.letter) = 1),
ends AS (
  SELECT b.conv_id, b.cost + 2 * len(n.letters) AS cost, b.audit || n.letters AS audit, list_concat(b.lines, CAST(n.lines AS VARCHAR[])) AS lines
  FROM best b JOIN inserts n ON n.came = b.state
  WHERE n.mid IN (0, 3) AND b.i = (SELECT COUNT(*) FROM steps s WHERE s.conv_id IS NOT DISTINCT FROM b.conv_id)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 2 * len(n.letters), b.audit || n.letters) = 1),
counts AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
    COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated,
    COUNT(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, LAG(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM steps) x GROUP BY conv_id)
SELECT e.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
  COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
