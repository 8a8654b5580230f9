"""Conversation repair: each conversation's rows become a signature of roles and faults, signatures of all conversations
share their suffixes in one automaton, and each node has its cheapest edits once for each state of the role grammar."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm import textops
from helixspark.llm.merkle import CRC32_SQL, crc32_sql
from helixspark.llm.runtime import partitions, spread, written

SPACES = " \t\n\x0b\f\r"
#: Costs of the edits, and what keeping or changing the role of a truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. _NEXT: by u or a, whichever may follow.
_START, _S, _U, _A = range(4)
_NEXT = (_U, _U, _A, _U)
_ROLE = {_U: "user", _A: "assistant"}
_KEPT = ({"s": _S, "u": _U}, {"u": _U}, {"a": _A}, {"u": _U})
_NEVER = 1 << 60

_SUMMARY = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])
_PLAN = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("n_new", pa.int64())])
_TURN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.large_string())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'string'}" for f in schema)


def turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations; a null role or text counts as one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))


def _in_order(rows: DataFrame, n: int, *first: str) -> DataFrame:
    """rows dealt by conversation, each conversation's in order: by turn, nulls first, then by role and text."""
    keys = [F.col("conv_id").asc_nulls_first(), *(F.col(c) for c in first), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return rows.repartition(n, "conv_id").sortWithinPartitions(*keys)


def _number(rows: DataFrame) -> int:
    return spread(rows.sparkSession, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], 16 << 20)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, initial, symbol, fault) in order to one row a conversation; only its symbols are held."""
    done: list[tuple] = []
    conv, open_ = None, False

    def closed():
        gaps = high - low + 1 - distinct if low is not None else 0
        return (conv, (gaps + (1 << 63)) % (1 << 64) - (1 << 63), *faults, illegal, signature.decode())

    for batch in batches:
        for c, turn, initial, symbol, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not open_ or c != conv:
                if open_:
                    done.append(closed())
                conv, open_, low, high, distinct, illegal, last = c, True, None, None, 0, 0, None
                faults, signature = [0, 0, 0], bytearray()
            if turn is not None:
                low = turn if low is None else low
                distinct += turn != high
                high = turn
            if last is not None and last + initial not in ("su", "ua", "au"):
                illegal += 1
            last = initial
            if fault:
                faults[fault - 1] += 1
            signature += symbol.encode()
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)
            done = []
    if open_:
        done.append(closed())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)


def signatures(rows: DataFrame, n: int) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of each conversation of rows(conv_id, turn, role, text).

    A row's symbol is x if it must go (no character but white space, or role and text of an earlier row), else its role's
    initial (o if that is not s, u or a), in upper case if its last character that is no space is none of ``.!?``.
    """
    tail = F.rtrim("text", F.lit(SPACES))
    blank = F.length(tail) == 0
    # one exchange: dealt by conversation, the rows of one role and text are together too
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    cut = ~F.right(tail, F.lit(1)).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(blank, 1).when(F.col("_seen"), 2).when(cut, 3).otherwise(0)
    symbol = F.when(F.col("fault").isin(1, 2), "x").when(F.col("fault") == 3, F.upper(own)).otherwise(own)
    marked = rows.repartition(n, "conv_id").withColumn("_seen", seen).withColumn("fault", fault).withColumn("symbol", symbol)
    # of equal rows of one turn the one that counts as first is first
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_seen")]
    return marked.sortWithinPartitions(*order).select("conv_id", "turn", initial.alias("initial"), "symbol", "fault").mapInArrow(_summaries, _ddl(_SUMMARY))


class Automaton:
    """The node of a suffix holds what the edits of the rows before it meet: cost-to-go and first edit by grammar state.

    A suffix's node is made from its first symbol and the node of the rest. Costs relative to their least take few
    values, so nodes refer to ``kinds``: (relative costs, first edits), each made once from (symbol, kind of the rest).
    """

    def __init__(self) -> None:
        self.kinds: list[tuple[tuple[int, ...], str]] = []
        self._known: dict[tuple, int] = {}
        self._steps: dict[tuple[str, int], tuple[int, int]] = {}
        self.end = self._kind([(0, "."), (_NEVER, ""), (_NEVER, ""), (0, ".")])[0]

    def _kind(self, own: list[tuple[int, str]]) -> tuple[int, int]:
        """The kind that a choice of (cost, edit) for each state gives, rows inserted before it counted, and its least cost."""
        cost = [c for c, _ in own]
        for _ in range(3):
            cost = [min(c, INSERT + cost[_NEXT[q]]) for q, c in enumerate(cost)]
        edits = "".join(min([e for c, e in (own[q], (INSERT + cost[_NEXT[q]], "I")) if c == cost[q]]) for q in range(4))
        least = min(cost)
        key = (tuple(c - least for c in cost), edits)
        if key not in self._known:
            self._known[key] = len(self.kinds)
            self.kinds.append(key)
        return self._known[key], least

    def before(self, symbol: str, kind: int) -> tuple[int, int]:
        """The kind of a suffix that begins with a symbol and goes on with a suffix of this kind, and the cost it adds."""
        step = self._steps.get((symbol, kind))
        if step is None:
            rest, extra = self.kinds[kind][0], TRUNCATED if symbol.isupper() else 0
            own = []
            for q in range(4):
                ways = [(DELETE + rest[q], "D")]
                if symbol != "x":
                    ways.append((REROLE + extra + rest[_NEXT[q]], "R"))
                    if (to := _KEPT[q].get(symbol.lower())) is not None:
                        ways.append((KEEP + extra + rest[to], "K"))
                own.append(min(ways))
            step = self._steps[(symbol, kind)] = self._kind(own)
        return step


def _walk(kinds: list, node_kind, signature: str) -> str:
    """The cheapest edits of a signature; node_kind(i) is the kind of its suffix from i on."""
    out, q, i = bytearray(), _START, 0
    while True:
        edit = kinds[node_kind(i)][1][q]
        if edit == ".":
            return out.decode()
        out += edit.encode()
        if edit in "IR":
            q = _NEXT[q]
        elif edit == "K":
            q = _KEPT[q][signature[i].lower()]
        i += edit != "I"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in the order of their reversals to plans: the nodes of the last signature's suffixes are held, and the
    next one begins with those that they share."""
    auto = Automaton()
    kind, base, last = array("H", [auto.end]), array("q", [0]), ""
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            turned = signature[::-1]
            n, most = 0, min(len(turned), len(last))
            step = 4096
            while n < most and step:  # the common suffix, in blocks and then by symbols
                if turned[n : n + step] == last[n : n + step] and n + step <= most:
                    n += step
                else:
                    step //= 8
            del kind[n + 1 :], base[n + 1 :]
            for symbol in turned[n:]:
                k, more = auto.before(symbol, kind[-1])
                kind.append(k)
                base.append(base[-1] + more)
            cost = base[-1] + auto.kinds[kind[-1]][0][_START]
            size = len(turned)
            rows.append((signature, cost, _walk(auto.kinds, lambda i, size=size: kind[size - i], signature), size - n))
            last = turned
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _PLAN, strict=True)], schema=_PLAN)


def plans(found: DataFrame) -> DataFrame:
    """(signature, cost, audit, n_new) of the different signatures of all conversations; n_new are the automaton's nodes
    that the signature adds to those of the ones before it.

    Signatures are sorted by their reversals in ranges, so those with a common suffix follow each other and its nodes
    are made once (the suffix that begins a range is made once more there). A task holds the nodes of one signature.
    """
    distinct = found.select("signature").distinct()
    turned = F.reverse("signature")
    return distinct.repartitionByRange(partitions(found.sparkSession), turned).sortWithinPartitions(turned).mapInArrow(_plans, _ddl(_PLAN))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, kind, role, text) in order, each conversation led by a row of kind 0 with its audit as text, to the
    rows that stay and those inserted."""
    held: list[tuple] = []
    size = place = at = 0
    audit, state, conv = "", _START, None

    def put(edit, role, text):
        nonlocal place, size
        held.append((conv, place, edit, role, text))
        place += 1
        size += len(text) + 100

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _NEXT[state]
            put("I", _ROLE[state], "")
            at += 1

    def flushed():
        nonlocal held, size
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), _TURN, strict=True)], schema=_TURN)
        held, size = [], 0

    for batch in batches:
        for c, kind, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if kind == 0:
                inserted()  # those at the end of the conversation before
                audit, at, state, place, conv = text, 0, _START, 0, c
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _KEPT[state][role[0]]
                put("K", role, text)
            elif edit == "R":
                state = _NEXT[state]
                put("R", _ROLE[state], text)
            if size > textops.SLICE:
                yield from flushed()
        yield from flushed()
    inserted()
    yield from flushed()


def repaired_turns(rows: DataFrame, audits: DataFrame, n: int) -> DataFrame:
    """(conv_id, place, edit, role, text): the conversations after the edits of audits(conv_id, audit).

    An audit goes before its conversation's rows as one row more, so it is not copied to each of them; a task passes the
    rows of a conversation on one by one. Partitions hold whole conversations in order.
    """
    head = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text").unionByName(head)
    return _in_order(both, n, "kind").select("conv_id", "kind", "role", "text").mapInArrow(_edited, _ddl(_TURN))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` rows, joined by line ends, from rows in order."""
    conv, state, done = None, None, []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    for batch in batches:
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(done) > 1000:
            yield flushed()
            done = []
    if state is not None:
        done.append((conv, state.hexdigest()))
    if done:
        yield flushed()


def repair(rows: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest edits of conversations, and the conversations after those edits.

    rows(conv_id, turn, role, text) without nulls in role and text (see ``turns``). A conversation's rows follow each
    other by turn, null turns first, then by role and text. A row is blank (nothing but ASCII white space), or a duplicate
    (role and text of an earlier row), or truncated (its last character that is no space is none of ``.!?``). Edits make
    the role initials ``(s?(ua)+)?``: keep (K), give another role (R, 1), delete (D, 2; blank and duplicate rows must go),
    insert a row without text (I, 5); a truncated row that stays costs 5 more. A row whose role has no s, u or a as its
    initial, an empty role too, cannot be kept as it is. Of equally cheap audits the least in ASCII order is taken.

    Returns (conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit) and the rows of
    ``repaired_turns``. Rows without a conv_id are one conversation. An empty table gives empty results.

    A conversation's signature and audit are one value, a byte a row; its texts are never held together, but pass through
    one task in order.
    """
    n = _number(rows) if n is None else n
    found = written(signatures(rows, n), "signatures")
    best = written(found.join(plans(found).drop("n_new"), "signature"), "audits")
    return best, repaired_turns(rows, best, n)


def damaged(convs: DataFrame) -> DataFrame:
    """The rows of ``turns`` with faults put in by r = CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 gives it the role user. A null id or turn
    counts as one space there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns(convs).withColumn("r", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("r") == 4, "user").otherwise(F.col("role"))
    copies: Column = F.when(F.col("r") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("r <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op11_query(spark, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, after = repair(damaged(convs))
    # the rows come in order from one stage, and are hashed in it
    digests = after.mapInArrow(_digests, _ddl(_DIGEST))
    ids = convs.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id", "signature")
    out = out.join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_BEST = "list_sort([{ways}])[1]"
#: By grammar state (0 start, 1 after s, 2 after u, 3 after a): cost and edits of the rows from one on, from the end.
OP11_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
r AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 r FROM conversations, crct),
d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END role, CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text
  FROM r, LATERAL (SELECT unnest(range(CASE WHEN r.r = 3 THEN 2 ELSE 1 END)) copy) WHERE r <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) tail FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) i FROM e),
f AS MATERIALIZED (SELECT *, substr(role, 1, 1) ini, CASE WHEN tail = '' THEN 1 WHEN seen THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) prev, count(*) OVER (PARTITION BY conv_id) n FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (WHERE fault = 1) blank, count(*) FILTER (WHERE fault = 2) duplicate, count(*) FILTER (WHERE fault = 3) truncated,
  count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY conv_id),
go AS (
  SELECT conv_id, n + 1 i, {{'c': 0::BIGINT, 'a': ''}} q0, {{'c': 10::BIGINT, 'a': 'II'}} q1, {{'c': 5::BIGINT, 'a': 'I'}} q2, {{'c': 0::BIGINT, 'a': ''}} q3 FROM f WHERE i = n
  UNION ALL
  SELECT conv_id, i, {_BEST.format(ways="w0, {'c': 5 + w2.c, 'a': 'I' || w2.a}, {'c': 10 + w3.c, 'a': 'II' || w3.a}")}, {_BEST.format(ways="w1, {'c': 5 + w2.c, 'a': 'I' || w2.a}, {'c': 10 + w3.c, 'a': 'II' || w3.a}")},
    {_BEST.format(ways="w2, {'c': 5 + w3.c, 'a': 'I' || w3.a}")}, {_BEST.format(ways="w3, {'c': 5 + w2.c, 'a': 'I' || w2.a}")}
  FROM (SELECT f.conv_id, f.i, {{'c': 2 + q0.c, 'a': 'D' || q0.a}} d0, {{'c': 2 + q1.c, 'a': 'D' || q1.a}} d1, {{'c': 2 + q2.c, 'a': 'D' || q2.a}} d2, {{'c': 2 + q3.c, 'a': 'D' || q3.a}} d3,
      CASE WHEN fault = 3 THEN 5 ELSE 0 END x, fault IN (0, 3) may,
      CASE WHEN may THEN list_sort([d0, {{'c': 1 + x + q2.c, 'a': 'R' || q2.a}}, CASE WHEN ini = 's' THEN {{'c': x + q1.c, 'a': 'K' || q1.a}} WHEN ini = 'u' THEN {{'c': x + q2.c, 'a': 'K' || q2.a}} ELSE d0 END])[1] ELSE d0 END w0,
      CASE WHEN may THEN list_sort([d1, {{'c': 1 + x + q2.c, 'a': 'R' || q2.a}}, CASE WHEN ini = 'u' THEN {{'c': x + q2.c, 'a': 'K' || q2.a}} ELSE d1 END])[1] ELSE d1 END w1,
      CASE WHEN may THEN list_sort([d2, {{'c': 1 + x + q3.c, 'a': 'R' || q3.a}}, CASE WHEN ini = 'a' THEN {{'c': x + q3.c, 'a': 'K' || q3.a}} ELSE d2 END])[1] ELSE d2 END w2,
      CASE WHEN may THEN list_sort([d3, {{'c': 1 + x + q2.c, 'a': 'R' || q2.a}}, CASE WHEN ini = 'u' THEN {{'c': x + q2.c, 'a': 'K' || q2.a}} ELSE d3 END])[1] ELSE d3 END w3
    FROM go JOIN f ON f.conv_id IS NOT DISTINCT FROM go.conv_id AND f.i = go.i - 1)),
best AS MATERIALIZED (SELECT conv_id, q0.c cost, q0.a audit FROM go WHERE i = 1),
step AS (
  SELECT conv_id, 0::BIGINT p, audit, 0::BIGINT i, 0 q, CAST(NULL AS VARCHAR) line FROM best
  UNION ALL
  SELECT s.conv_id, p + 1, audit, CASE WHEN e = 'I' THEN s.i ELSE s.i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND ini = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN role || ':' || text ELSE CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'I' THEN '' ELSE text END END
  FROM (SELECT *, substr(audit, p + 1, 1) e FROM step WHERE p < length(audit)) s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1),
after AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) t FROM step WHERE line IS NOT NULL GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cost, 0) cost, coalesce(audit, '') audit, sha256(coalesce(t, '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN after ON after.conv_id IS NOT DISTINCT FROM k.conv_id
"""
