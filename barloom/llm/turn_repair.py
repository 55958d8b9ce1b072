"""Repair of conversations whose turns are missing, doubled, cut short or out of order, at the least cost.

A conversation should read ``s?(ua)+`` by the initials of its roles, or be empty. Its rows are walked in the order of
turns. Each of the four states of that grammar (nothing yet, after the system's turn, after the user's, after the
assistant's) carries the least pair of cost and audit string, the initials of the edits that lead there: a row is kept,
given another role or deleted, and each row's layer is closed by the insertions that may follow it. Strings of equal
cost never begin with one another, since the letters but ``I`` are as many as the rows and tell the cost of their
edits, so the least pair of a state stays least whatever follows.

What all four states agree on is told at once and forgotten, so a conversation streams through its task however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import fresh

#: Costs of the edits; rows that are cut short add one more cost unless deleted.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each initial leads to, by the state before: what isn't here isn't allowed.
STEPS = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
#: The role that an edit can give in each state, and the state it leads to.
GIVEN = {NOTHING: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
#: Insertions after one another that can be worth while: a third one would come back to a state of one of the others.
INSERTIONS = 2
#: Rows between two looks for what all states agree on.
SETTLE = 32
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
SPACE = " \t\n\x0b\x0c\r"


class Repair:
    """One conversation's states; rows come in order, and edits are told as soon as all states share them."""

    def __init__(self, settle: int = SETTLE):
        self.settle = settle
        #: By state: cost and the edits not yet told, as a string.
        self.states: dict[int, tuple[int, str]] = {NOTHING: (0, "")}
        self.waiting: list[tuple[str, str]] = []  # rows that the strings' letters but I belong to
        self.before = NOTHING  # the state before the first edit not yet told
        self.rows = 0
        self._close()

    def _close(self) -> None:
        for _ in range(INSERTIONS):
            for state, (cost, audit) in sorted(self.states.items()):
                _, to = GIVEN[state]
                self._offer(self.states, to, (cost + INSERT, audit + "I"))

    @staticmethod
    def _offer(states: dict, to: int, pair: tuple[int, str]) -> None:
        if to not in states or pair < states[to]:
            states[to] = pair

    def push(self, role: str, text: str, fault: str | None) -> Iterator[tuple[str, str, str]]:
        """Take a row; gives (edit, role, text) of the edits that are now sure."""
        initial, extra = role[:1], CUT_SHORT if fault == TRUNCATED else 0
        after: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.states.items():
            self._offer(after, state, (cost + DELETE, audit + "D"))
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in STEPS:
                    self._offer(after, STEPS[state, initial], (cost + KEEP + extra, audit + "K"))
                self._offer(after, GIVEN[state][1], (cost + REROLE + extra, audit + "R"))
        self.states = after
        self._close()
        self.waiting.append((role, text))
        self.rows += 1
        if self.rows % self.settle == 0:
            # What can follow the first two states can follow the last one, for a system's turn deleted at most.
            last = self.states[ASSISTANT][0]
            self.states = {s: p for s, p in self.states.items() if s in (USER, ASSISTANT) or p[0] <= last + (DELETE if s == NOTHING else 0)}
            least, most = min(a for _, a in self.states.values()), max(a for _, a in self.states.values())
            shared = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))
            if shared:
                self.states = {s: (c, a[shared:]) for s, (c, a) in self.states.items()}
                yield from self._tell(least[:shared])

    def finish(self) -> tuple[int, Iterator[tuple[str, str, str]]]:
        """The cost, and the edits that were not told yet."""
        cost, audit = min(self.states[s] for s in (NOTHING, ASSISTANT) if s in self.states)
        return cost, self._tell(audit)

    def _tell(self, audit: str) -> Iterator[tuple[str, str, str]]:
        used = 0
        for edit in audit:
            role, text = "", ""
            if edit != "I":
                role, text = self.waiting[used]
                used += 1
            if edit in "RI":
                role, self.before = GIVEN[self.before]
            elif edit == "K":
                self.before = STEPS[self.before, role[:1]]
            yield edit, role, text
        del self.waiting[:used]


def _filled(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in, as the checksum of conversation and turn tells: ``conv``, ``turn``, ``role``, ``text``.

    Of 20 values 0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` away, 3 repeats it, 4 makes it
    the user's. Null roles and texts become one space, and so do null conversations and turns in the checksum.
    """
    fault = F.crc32(F.concat(_filled(conv), F.lit(":"), _filled(turn))) % 20
    return (
        rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), _filled(role).alias("role"), _filled(text).alias("text"), fault.alias("fault"))
        .where("fault <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with ``fault``: the first of blank, duplicate, truncated that holds, or null.

    A row is a duplicate if one before it, by turn, has its role and text. Rows of one conversation, role and text
    are dealt by all three, so that a long conversation isn't one task's.
    """
    said = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    return rows.select("conv_id", "turn", "role", "text", said.alias("said"), seen.alias("seen")).select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("said") == "", BLANK).when(F.col("seen"), DUPLICATE).when(~F.substring("said", -1, 1).isin(".", "!", "?"), TRUNCATED).alias("fault"),
    )


def _streamed(rows: DataFrame) -> DataFrame:
    """The rows with their faults, each conversation's together and in order: by turn (nulls first), role, text, and a
    duplicate behind the row it repeats."""
    return (
        faults(rows).repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", F.col("fault").eqNullSafe(DUPLICATE))
    )


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Summary:
    """What is told of one conversation, row by row."""

    def __init__(self):
        self.first = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.initial: str | None = None
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def row(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial

    def edit(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.hash.update(f"{'\n' if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def told(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``rows``: counts of faults, gaps and illegal neighbours, the least cost of a
    repair, its audit string and the digest of the repaired conversation.

    ``rows`` has ``conv_id`` (any type that sorts), ``turn`` (integers), ``role`` and ``text``, neither of which is null;
    other columns are left out. Null is a conversation of its own. Rows of equal turn go by role and text, so the
    result doesn't depend on the order of rows; repeated rows are duplicates. Empty texts are blank. Texts of any length
    are taken whole. An empty table gives no rows. A conversation's digest is one hash in order, so it streams through
    one task, sorted outside of memory; only its audit string, a letter for each edit, is held.
    """
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(_SUMMARY).fields])
    arrow = _arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        repair = summary = conv = None

        def end() -> None:
            summary.cost, edits = repair.finish()
            for edit in edits:
                summary.edit(*edit)
            found.append((conv, *summary.told()))

        for key, turn, role, text, fault in _each(batches):
            if repair is None or key != conv:
                if repair:
                    end()
                if len(found) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in found], arrow)
                    found.clear()
                repair, summary, conv = Repair(), _Summary(), key
            summary.row(turn, role, fault)
            for edit in repair.push(role, text, fault):
                summary.edit(*edit)
        if repair:
            end()
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in found], arrow)

    return _streamed(rows).mapInArrow(of, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I), ``role`` and ``text``, one row
    for each turn that stands. Rows are taken as in ``summaries``; a conversation of which nothing stands has none."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL("place long, edit string, role string, text string").fields])
    arrow = _arrow_schema(schema)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        repair = conv = None
        for key, _, role, text, fault in _each(batches):
            if repair is None or key != conv:
                if repair:
                    yield from ((conv, *e) for e in repair.finish()[1])
                repair, conv = Repair(), key
            yield from ((key, *e) for e in repair.push(role, text, fault))
        if repair:
            yield from ((conv, *e) for e in repair.finish()[1])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        conv, place = object(), 0
        for key, edit, role, text in edits(batches):
            if edit == "D":
                continue
            place = place + 1 if key == conv else 0
            conv = key
            found.append({"conv_id": key, "place": place, "edit": edit, "role": role, "text": text})
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist(found, arrow)
                found.clear()
        yield pa.RecordBatch.from_pylist(found, arrow)

    return _streamed(rows).mapInArrow(of, schema)


def repair_damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``summaries`` of the damaged rows, one for each conversation of ``rows``; of those without rows left zeros, an empty
    audit and the digest of nothing."""
    found = summaries(damaged(rows, conv, turn, role, text))
    (own,) = fresh(found, "_conv")
    all_of = rows.select(F.col(conv).alias(own)).distinct()
    zeros = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_of.join(found, all_of[own].eqNullSafe(found["conv_id"]), "left").select(
        F.col(own).alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


#: The checksum is told bit by bit; each state is one string of cost, audit and repaired text, so the least string is the least state.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS f
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM t WHERE f <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d),
r AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair, CASE WHEN said = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
e AS (SELECT *, fault IN ('blank', 'duplicate') AS out_, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, role[1] AS c FROM r),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, ['0', '', ''], ['1000000000', '', ''], ['5', 'I', E'\nuser:'], ['10', 'II', E'\nuser:\nassistant:'] FROM c
  UNION ALL
  SELECT conv_id, i, s0, s1, u2, least_of([a3, [(u2[1]::INT + 5)::VARCHAR, u2[2] || 'I', u2[3] || E'\nassistant:']])
  FROM (
    SELECT conv_id, i, s0, s1, a3, least_of([a2, [(s0[1]::INT + 5)::VARCHAR, s0[2] || 'I', s0[3] || E'\nuser:'], [(s1[1]::INT + 5)::VARCHAR, s1[2] || 'I', s1[3] || E'\nuser:'],
             [(a3[1]::INT + 5)::VARCHAR, a3[2] || 'I', a3[3] || E'\nuser:']]) AS u2
    FROM (
      SELECT dp.conv_id, e.i, [(s0[1]::INT + 2)::VARCHAR, s0[2] || 'D', s0[3]] AS s0,
        least_of([[(s1[1]::INT + 2)::VARCHAR, s1[2] || 'D', s1[3]], CASE WHEN NOT out_ AND c = 's' THEN [(s0[1]::INT + extra)::VARCHAR, s0[2] || 'K', s0[3] || E'\n' || role || ':' || text] END]) AS s1,
        least_of([[(s2[1]::INT + 2)::VARCHAR, s2[2] || 'D', s2[3]]] || CASE WHEN out_ THEN [] ELSE flatten(list_transform([s0, s1, s3], lambda s:
          [CASE WHEN c = 'u' THEN [(s[1]::INT + extra)::VARCHAR, s[2] || 'K', s[3] || E'\n' || role || ':' || text] END,
           [(s[1]::INT + 1 + extra)::VARCHAR, s[2] || 'R', s[3] || E'\nuser:' || text]])) END) AS a2,
        least_of([[(s3[1]::INT + 2)::VARCHAR, s3[2] || 'D', s3[3]], CASE WHEN NOT out_ AND c = 'a' THEN [(s2[1]::INT + extra)::VARCHAR, s2[2] || 'K', s2[3] || E'\n' || role || ':' || text] END,
          CASE WHEN NOT out_ THEN [(s2[1]::INT + 1 + extra)::VARCHAR, s2[2] || 'R', s2[3] || E'\nassistant:' || text] END]) AS a3
      FROM dp JOIN e ON dp.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = dp.i + 1))),
f AS (SELECT c.*, least_of([s0, s3]) AS s FROM c JOIN dp ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s[1]::BIGINT, 0) AS cost, coalesce(s[2], '') AS audit, sha256(coalesce(s[3][2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id
"""


def _inlined(sql: str) -> str:
    """``least_of(list)``: the least by cost and audit of the list's states that aren't null, or one too dear to be taken."""
    out, at = "", 0
    while (start := sql.find("least_of(", at)) >= 0:
        depth, end = 1, start + len("least_of(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _inlined(sql[start + len("least_of(") : end - 1])
        pick = "lambda x, y: CASE WHEN (x[1]::INT, x[2]) <= (y[1]::INT, y[2]) THEN x ELSE y END"
        out += f"{sql[at:start]}list_reduce([['1000000000', '', '']] || list_filter({inner}, lambda z: z IS NOT NULL), {pick})"
        at = end
    return out + sql[at:]


ORACLE = _inlined(SQL)
