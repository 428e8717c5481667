"""Repair of conversations: generalised LR over the grammar of roles, with weighted edits.

Rows of a conversation are the input symbols.  The automaton of ``GRAMMAR`` (its item sets, built
here) reads them; wherever a row does not fit, the parser also tries to delete it, to give it
another role, or to insert a row before it.  All stacks live at once in a graph: a node is a
state on top of another node and exists once, so stacks share what lies below.  Ways that lead
to the same stack top merge, and the least (cost, audit) stays; the audit is the string of the
edits' initials.  The SHA-256 of the repaired text grows with each surviving stack, so
a conversation streams past in order and only its audit is held, a byte per row.  Grammars must
be left recursive, so that stacks stay shallow.

A row's first fault counts: blank (no visible character), duplicate (role and text seen earlier
in the conversation), truncated (the last visible character does not end a sentence).  Keep costs
nothing, Rerole 1, Delete 2, Insert 5; blank and duplicate rows must be deleted; a truncated row
that stays costs 5 more.  ASCII decides between edits of equal cost.

Copies (conversation, turn, role and text equal) are counted before they move; whether a role and
text came earlier is told by a join on their digest, in any number of tasks; then each
conversation's rows stream through one task in order, sorted on disk if need be, because a digest
of the whole conversation can only be taken in sequence.  Nothing is collected but the audit.

Null roles and texts are one space.  Rows are ordered by turn (nulls first), then role and text.
A null conversation id is a conversation.  A role without a character cannot stay as it is.
Conversations without rows give zeros, an empty audit and the digest of the empty string.  Extra
columns are not read; an empty table gives no rows.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Window, functions as F
from pyspark.sql.types import StructType

from stockmill.llm.common import slices, unbounded

#: ``(s?(ua)+)?`` by role initials; the first symbol is the start.
GRAMMAR = (("Conversation", ()), ("Conversation", ("Turns",)), ("Conversation", ("s", "Turns")),
           ("Turns", ("Pair",)), ("Turns", ("Turns", "Pair")), ("Pair", ("u", "a")))
#: Roles that may be given or inserted, by initial.
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_CHUNK = 4096
_OUT_ROWS = 2000
_MAX = (1 << 63) - 1
_COLUMNS = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "cost bigint, audit string, repaired_sha256 string, given string")
_EDITS = "n bigint, inserted string, edit string, given string, place bigint"


class Automaton:
    """LR(0) item sets: ``moves[state][symbol]``, ``reduces[state]`` as (symbol, length),
    ``accepts[state]``."""

    def __init__(self, grammar):
        start = grammar[0][0]
        rules = {}
        for i, (left, _) in enumerate(grammar):
            rules.setdefault(left, []).append(i)

        def closure(items):
            items = set(items)
            todo = list(items)
            while todo:
                rule, dot = todo.pop()
                after = grammar[rule][1][dot:dot + 1]
                for new in rules.get(after[0], ()) if after else ():
                    if (new, 0) not in items:
                        items.add((new, 0))
                        todo.append((new, 0))
            return frozenset(items)

        states = [closure((i, 0) for i in rules[start])]
        self.moves, self.reduces, self.accepts = [], [], []
        for state in states:  # grows
            ended = [grammar[r] for r, dot in state if dot == len(grammar[r][1])]
            self.accepts.append(any(left == start for left, _ in ended))
            self.reduces.append([(left, len(right)) for left, right in ended if left != start])
            nexts = {}
            for rule, dot in state:
                if dot < len(grammar[rule][1]):
                    nexts.setdefault(grammar[rule][1][dot], set()).add((rule, dot + 1))
            self.moves.append({})
            for symbol in sorted(nexts):
                target = closure(nexts[symbol])
                if target not in states:
                    states.append(target)
                self.moves[-1][symbol] = states.index(target)


class Stacks:
    """The graph of stacks: node 0 is the bottom; a node is (state, node below) and exists once."""

    def __init__(self, grammar=GRAMMAR, roles=None):
        self._lr, self._roles = Automaton(grammar), roles or ROLES
        self._nodes, self._number = [(0, None)], {(0, None): 0}
        self._inserted = lru_cache(None)(self._inserted)
        self.edits = lru_cache(4096)(self._edits)

    def _push(self, below, state):
        key = (state, below)
        if key not in self._number:
            self._number[key] = len(self._nodes)
            self._nodes.append(key)
        return self._number[key]

    def _shift(self, node, symbol):
        """All stacks after a shift and the reductions that follow."""
        target = self._lr.moves[self._nodes[node][0]].get(symbol)
        if target is None:
            return
        todo = [self._push(node, target)]
        while todo:
            top = todo.pop()
            state = self._nodes[top][0]
            yielded = not self._lr.reduces[state] or self._lr.moves[state]
            for left, length in self._lr.reduces[state]:
                below = top
                for _ in range(length):
                    below = self._nodes[below][1]
                todo.append(self._push(below, self._lr.moves[self._nodes[below][0]][left]))
            if yielded or self._lr.accepts[state]:
                yield top

    def _inserted(self, node):
        """{stack: (cost, letters, roles)}: the cheapest ways by insertions alone."""
        best, todo = {node: (0, "", ())}, [node]
        while todo:
            at = todo.pop(0)
            cost, letters, roles = best[at]
            for initial, role in self._roles.items():
                way = (cost + COST[INSERT], letters + INSERT, (*roles, role))
                for top in self._shift(at, initial):
                    if top not in best or way < best[top]:
                        best[top] = way
                        todo.append(top)
        return best

    def _edits(self, node, initial, fault):
        """Ways past a row: (stack, cost, letters, inserted roles, the row's role).

        The row's role is None when it is deleted and "" when it is kept.
        """
        out = []
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for at, (cost, letters, roles) in self._inserted(node).items():
            out.append((at, cost + COST[DELETE], letters + DELETE, roles, None))
            if fault in (BLANK, DUPLICATE):
                continue
            for top in self._shift(at, initial):
                out.append((top, cost + COST[KEEP] + extra, letters + KEEP, roles, ""))
            for symbol, role in self._roles.items():
                for top in self._shift(at, symbol):
                    out.append((top, cost + COST[REROLE] + extra, letters + REROLE, roles, role))
        return out

    def ends(self, node):
        """Ways to an accepted conversation by insertions: (cost, letters, inserted roles)."""
        return [way for at, way in self._inserted(node).items()
                if self._lr.accepts[self._nodes[at][0]]]


class Way:
    """The best way to one stack: cost, audit in chunks, digest of the repaired rows.

    Chunks hold a letter of the audit and the initial of the role it gives (or ``-``) by turns.
    Audits of one row count are never prefixes of each other, so ``rank`` orders them.
    """

    __slots__ = ("cost", "rank", "chunks", "recent", "digest", "any")

    def __init__(self, cost, rank, chunks, recent, digest, any_row):
        self.cost, self.rank, self.chunks, self.recent = cost, rank, chunks, recent
        self.digest, self.any = digest, any_row

    def edits(self):
        """The audit, and the initials of the roles given."""
        parts, chunks = [self.recent], self.chunks
        while chunks:
            parts.append(chunks[1])
            chunks = chunks[0]
        both = "".join(reversed(parts))
        return both[::2], both[1::2]

    def then(self, cost, letters, roles, new=None, row=None):
        """This way and further edits; ``new`` is the row's role (None: deleted, "": kept)."""
        given = "".join(r[0] for r in roles) + ((new or "-")[0] if len(letters) > len(roles) else "")
        chunks, recent = self.chunks, self.recent + "".join(map("".join, zip(letters, given)))
        if len(recent) >= _CHUNK:
            chunks, recent = (chunks, recent), ""
        digest, any_row = self.digest, self.any
        lines = [f"{role}:" for role in roles]
        if new is not None:
            lines.append(f"{new or row[0]}:{row[1]}")
        if lines:
            digest = digest.copy()
            digest.update(("\n" * any_row + "\n".join(lines)).encode())
        return Way(self.cost + cost, 0, chunks, recent, digest, any_row or bool(lines))


class Repair:
    """One conversation, row by row."""

    def __init__(self, stacks):
        self._stacks = stacks
        self._live = {0: Way(0, 0, None, "", hashlib.sha256(), False)}
        self.counts = [0] * 4
        self.illegal, self.turns, self._ends, self._initial = 0, 0, None, None

    def row(self, turn, role, text, fault):
        self.counts[fault] += 1
        initial = role[:1]
        if self._initial is not None and self._initial + initial not in LEGAL:
            self.illegal += 1
        self._initial = initial
        if turn is not None:
            if self._ends is None:
                self._ends = [turn, turn]
            self.turns += self.turns == 0 or turn != self._ends[1]
            self._ends[1] = turn
        best = {}
        for node, way in self._live.items():
            for top, cost, letters, roles, new in self._stacks.edits(node, initial, fault):
                tried = (way.cost + cost, way.rank, letters, node, roles, new)
                if top not in best or tried[:3] < best[top][:3]:
                    best[top] = tried
        live = {}
        for rank, top in enumerate(sorted(best, key=lambda t: best[t][1:3])):
            _, _, letters, node, roles, new = best[top]
            old = self._live[node]
            live[top] = old.then(best[top][0] - old.cost, letters, roles, new, (role, text))
            live[top].rank = rank
        self._live = live

    def result(self):
        """Values of ``_COLUMNS``."""
        cost, _, letters, roles, node = min(
            (way.cost + cost, way.rank, letters, roles, node)
            for node, way in self._live.items()
            for cost, letters, roles in self._stacks.ends(node))
        way = self._live[node]
        way = way.then(cost - way.cost, letters, roles)
        gaps = self._ends[1] - self._ends[0] + 1 - self.turns if self._ends else 0
        audit, given = way.edits()
        return (min(gaps, _MAX), *self.counts[BLANK:], self.illegal, way.cost, audit,
                way.digest.hexdigest(), given)


def _taken(rows, conv, turn, role, text, copies):
    space = F.lit(" ")
    return rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`"), space).alias("text"),
        (F.lit(1) if copies is None else F.col(f"`{copies}`")).cast("bigint").alias("copies"))


def _prepared(rows):
    """Distinct rows with their number of copies, whether an earlier turn has the same role and
    text, and the fault a first copy has by itself."""
    known = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    known = known.withColumn("digest", F.sha2(F.concat(
        F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    present = known.where("copies > 0")
    # turns as (is there one, turn), so that nulls come first and are equal
    spot = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    firsts = present.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(
        F.min(spot).alias("spot"))
    visible = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(visible == "", BLANK).when(
        F.col("earlier"), DUPLICATE).when(
        ~F.right(visible, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return known.join(
        unbounded(firsts), F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")),
        "left").withColumn("earlier", F.coalesce(~F.col("turn").eqNullSafe(
            F.col("spot.turn")), F.lit(False))).select(
        "conv", "turn", "role", "text", "copies", fault.cast("tinyint").alias("fault"))


def _order():
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(rows, conv="conv_id", turn="turn", role="role", text="text", copies=None,
           grammar=GRAMMAR):
    """One row per conversation: ``conv``, counts of faults, cost, audit, digest of the repaired
    rows, and ``given``: per edit, the initial of the role it gives, or ``-``.

    ``copies`` is a column that says how often a row stands there; a row that stands there 0
    times only keeps its conversation in the result.
    """
    known = _prepared(_taken(rows, conv, turn, role, text, copies))
    sorted_rows = known.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), *_order())
    schema = StructType([sorted_rows.schema["conv"], *StructType.fromDDL(_COLUMNS)])

    def run(batches):
        stacks = Stacks(grammar)
        open_conv, now, done = None, None, []

        def packed():
            columns = list(zip(*done)) or [()] * len(schema.names)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

        for batch in slices(batches):
            kinds = [batch.column("conv").type, *[pa.int64()] * 6, *[pa.string()] * 3]
            for c, at, r, t, n, fault in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or c != open_conv:
                    if now is not None:
                        done.append((open_conv, *now.result()))
                    if len(done) >= _OUT_ROWS:
                        yield packed()
                    open_conv, now = c, Repair(stacks)
                for i in range(n):
                    now.row(at, r, t, DUPLICATE if i and fault != BLANK else fault)
        if now is not None:
            done.append((open_conv, *now.result()))
            yield packed()

    return sorted_rows.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def repaired_rows(rows, repaired, conv="conv_id", turn="turn", role="role", text="text",
                  copies=None, roles=None):
    """The repaired conversations, a row per message: ``conv``, place (from 0), role, text, turn
    of the row it comes from (null: inserted).  ``repaired`` is what ``repair`` gave for ``rows``.

    Audits are taken apart per row and joined to the rows by their number in the conversation.
    """
    names = roles or ROLES
    schema = StructType([repaired.schema[conv], *StructType.fromDDL(_EDITS)])

    def take_apart(batches):
        for batch in slices(batches):
            out = {name: [] for name in schema.names}
            for c, audit, given in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = place = first = 0
                for i, letter in enumerate(audit + DELETE):  # a last step for what is inserted
                    if letter == INSERT:
                        continue
                    values = (c, n, given[first:i], letter, given[i:i + 1], place)
                    for column, value in zip(out.values(), values):
                        column.append(value)
                    place += i - first + (letter != DELETE)
                    n, first = n + 1, i + 1
            kinds = [batch.column(0).type, pa.int64(), *[pa.string()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds)], names=schema.names)

    edits = repaired.select(conv, "audit", "given").mapInArrow(take_apart, schema)
    before = Window.partitionBy("conv").orderBy(*_order()).rowsBetween(
        Window.unboundedPreceding, -1)
    known = _taken(rows, conv, turn, role, text, copies).groupBy(
        "conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    numbered = known.withColumn("first", F.coalesce(F.sum("copies").over(before), F.lit(0))).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("i")).select(
        "conv", "turn", "role", "text", (F.col("first") + F.col("i")).alias("number"))
    known_edits = edits.withColumnRenamed(conv, "c")
    joined = known_edits.join(
        unbounded(numbered), F.col("c").eqNullSafe(F.col("conv")) & (F.col("n") == F.col("number")),
        "left")
    role_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    width = F.length("inserted")
    new = F.transform(
        F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            (F.col("place") + i - 1).alias("place"),
            role_of[F.substring("inserted", i, F.lit(1))].alias("role"), F.lit("").alias("text"),
            F.lit(None).cast("bigint").alias("turn")))
    own = F.when(F.col("edit") == DELETE, F.array().cast(new_type(joined.select(new)))).otherwise(
        F.array(F.struct(
            (F.col("place") + width).alias("place"),
            F.when(F.col("edit") == KEEP, F.col("role")).otherwise(
                role_of[F.col("given")]).alias("role"), "text", "turn")))
    return joined.select(F.col("c").alias(conv), F.inline(F.concat(new, own)))


def new_type(df):
    return df.schema[0].dataType


def damaged(conversations):
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20, with a number of copies (0: dropped)."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(F.when(code > 0, role)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(
            F.when(code > 0, text)).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))
