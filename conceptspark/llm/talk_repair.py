"""Conversation structure repair by a grammar-compressed dynamic programme.

A row of a conversation is one of nine symbols: its role's initial (system, user, assistant,
other), small where the text is whole and capital where it is cut short, or ``X`` where the row
must go (blank, or said before).  The cheapest edits that give role initials ``(s?(ua)+)?`` are a
path through four states, so a row is a 4 x 4 matrix of (cost, audit) and a conversation the
min-plus product of its rows' matrices.

Re-Pair finds pairs of symbols that stand side by side often, in all conversations: every round
counts pairs as a Spark job and makes rules of the most frequent ones that don't overlap.  A
rule's matrix is the product of its two parts; its audits are ropes that share the parts'
ropes.  Rules are evaluated bottom-up once a task and shared by all conversations.  The
grammar only saves work: however few rules there are, results are the same.

Rows are range-sorted by conversation and turn, so a conversation of any size is spread over
tasks, and cut into pieces of bounded size.  Conversations in one piece are repaired where they
are read; those of several pieces send each piece's matrix, and then its texts, along in order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.runtime import stored

#: Rows and characters of text that a piece of a conversation holds at most (one row at least).
PIECE_ROWS, PIECE_CHARS = 2048, 2_000_000
#: Bounds of the grammar; they change the work, never a result.
#: A rule costs a task 64 sums and saves 16 at each use, so rare pairs don't pay.
MAX_RULES, MAX_ROUNDS, LEAST = 1024, 8, 16
#: Sequences whose audits a task remembers.
REMEMBERED = 20_000
WHITE = " \t\n\x0b\x0c\r"
#: Rule symbols start here, in a private area of Unicode.
BASE = 0xF0000

#: States: nothing said, a system turn said, a user turn said, an assistant turn said.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Inserted turns that lead from a state to another, at least.
INSERTS = {(i, i): 0 for i in STATES} | {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
#: Inserted turns that make an end in each state a legal one.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
#: Costs of edits.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}


class Rope:
    """A string as the concatenation of two ropes; leaves are strings."""

    __slots__ = ("left", "right")

    def __init__(self, left, right):
        self.left, self.right = left, right


def join(a, b):
    return b if a == "" else a if b == "" else Rope(a, b)


def text_of(rope) -> str:
    out, stack = [], [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, Rope):
            stack += (r.right, r.left)
        else:
            out.append(r)
    return "".join(out)


def less(a, b) -> bool:
    """Whether rope ``a`` comes before rope ``b``; parts that both share are passed over whole."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if isinstance(p, Rope):
            x += (p.right, p.left)
            y.append(q)
        elif isinstance(q, Rope):
            y += (q.right, q.left)
            x.append(p)
        else:
            n = min(len(p), len(q))
            if p[:n] != q[:n]:
                return p[:n] < q[:n]
            if len(p) > n:
                x.append(p[n:])
            if len(q) > n:
                y.append(q[n:])
    return bool(y)


def best(options):
    """The cheapest (cost, rope), of equal ones the one whose rope comes first; None of none."""
    won = None
    for o in options:
        if won is None or o[0] < won[0] or (o[0] == won[0] and less(o[1], won[1])):
            won = o
    return won


def product(a: list, b: list) -> list:
    """Min-plus product of matrices (row by row, any number of rows) of (cost, rope) or None."""
    out = []
    for i in range(0, len(a), 4):
        for j in STATES:
            out.append(best((a[i + k][0] + b[4 * k + j][0], join(a[i + k][1], b[4 * k + j][1])) for k in STATES if a[i + k] and b[4 * k + j]))
    return out


#: The start of a conversation as a matrix of one row.
START = [(0, ""), None, None, None]
ONE = [(0, "") if i == j else None for i in STATES for j in STATES]


def row_matrix(symbol: str) -> list:
    """Edits of one row, after any turns inserted before it."""
    short = symbol in "SUAO"
    more = CUT_SHORT if short else 0

    def edits(k, j):
        if k == j:
            yield DELETE, "D"
        if symbol != "X":
            if STEP.get((k, symbol.lower())) == j:
                yield more, "K"
            if j in (STEP.get((k, "u")), STEP.get((k, "a"))):
                yield REROLE + more, "R"

    return [best((INSERT * INSERTS[i, k] + c, "I" * INSERTS[i, k] + e) for k in STATES if (i, k) in INSERTS for c, e in edits(k, j)) for i in STATES for j in STATES]


class Grammar:
    """Rules (round by round) and their matrices, worked out when first asked for."""

    def __init__(self, rounds: list[list[tuple[str, str]]]):
        self.rounds = rounds
        self.rules = [dict(r) for r in rounds]

    def __reduce__(self):
        return Grammar, (self.rounds,)

    def compress(self, symbols: str) -> str:
        """Replace pairs round by round, from the left; pairs of one round never overlap."""
        for rules in self.rules:
            out, at, n = [], 0, len(symbols)
            if n < 2:
                break
            while at < n:
                name = rules.get(symbols[at : at + 2])
                out.append(name or symbols[at])
                at += 2 if name else 1
            symbols = "".join(out)
        return symbols

    def matrix(self, symbol: str) -> list:
        """The matrix of a symbol; all rules are evaluated bottom-up the first time."""
        if not hasattr(self, "matrices"):
            self.matrices = {s: row_matrix(s) for s in "suaoSUAOX"}
            for pair, name in (rule for r in self.rounds for rule in r):
                self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        return self.matrices[symbol]

    def run(self, symbols: str, begin: list) -> list:
        for s in self.compress(symbols):
            begin = product(begin, self.matrix(s))
        return begin


def count_pairs(symbols: str) -> Counter:
    """Pairs that stand side by side; of a run of one symbol, those that don't overlap."""
    out: Counter = Counter()
    last = -2
    for i in range(len(symbols) - 1):
        pair = symbols[i : i + 2]
        if pair[0] == pair[1] and last == i - 1 and symbols[last] == pair[0]:
            continue
        last = i if pair[0] == pair[1] else -2
        out[pair] += 1
    return out


def choose(counted: list[tuple[str, int]], room: int) -> list[str]:
    """The most frequent pairs of which no two can share a symbol of a sequence."""
    firsts: set[str] = set()
    seconds: set[str] = set()
    doubles: set[str] = set()
    out = []
    for pair, _ in counted:
        a, b = pair
        if len(out) == room:
            break
        if a == b:
            if a in firsts or a in seconds:
                continue
            doubles.add(a)
        elif a in seconds or b in firsts or a in doubles or b in doubles:
            continue
        firsts.add(a)
        seconds.add(b)
        out.append(pair)
    return out


def learn(sequences: DataFrame, max_rules: int = MAX_RULES, max_rounds: int = MAX_ROUNDS, least: int = LEAST) -> Grammar:
    """A grammar of a table (symbols, n) of distinct sequences and how often each stands there.

    Rounds work on written tables.  To the driver come at most ``max_rules`` pairs a round.
    """

    def counted(batches):
        for pdf in batches:
            total: Counter = Counter()
            for s, n in zip(pdf["symbols"], pdf["n"]):
                for pair, k in count_pairs(s).items():
                    total[pair] += k * int(n)
            yield _frame(pair=list(total), k=list(total.values()))

    rounds: list[list[tuple[str, str]]] = []
    made = 0
    while len(rounds) < max_rounds and made < max_rules:
        pairs = sequences.mapInPandas(counted, "pair string, k long").groupBy("pair").agg(F.sum("k").alias("k")).where(F.col("k") >= least)
        top = [(r["pair"], r["k"]) for r in pairs.orderBy(F.col("k").desc(), "pair").limit(max_rules).collect()]
        chosen = choose(top, max_rules - made)
        if not chosen:
            break
        rules = [(pair, chr(BASE + made + i)) for i, pair in enumerate(chosen)]
        made += len(rules)
        rounds.append(rules)
        one = Grammar([rules])

        def shorter(batches, one=one):
            for pdf in batches:
                kept = [(c, n) for c, n in zip(map(one.compress, pdf["symbols"]), pdf["n"]) if len(c) > 1]
                yield _frame(symbols=[c for c, _ in kept], n=[n for _, n in kept])

        sequences = stored(sequences.mapInPandas(shorter, "symbols string, n long"), "talk-sequences")
    return Grammar(rounds)


def _frame(**columns):
    import pandas as pd

    return pd.DataFrame(columns)


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 500, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples, of bounded rows and about bounded characters."""
    held: list[tuple] = []
    size = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum(len(x) if isinstance(x, str) else sum(len(y) if isinstance(y, str) else 16 for y in x) if isinstance(x, list) else 16 for x in r)
        if len(held) >= at_once or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a bounded stretch at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") and role else "o"


def symbols_of(inits: str, faults: str) -> str:
    return "".join("X" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(inits, faults))


PIECE = (
    "part int, seq int, several boolean, inits string, faults string, symbols string, turn_low long, turn_high long, turns long, "
    "ids array<binary>, roles array<string>, texts array<string>"
)


def _pieces(rows: DataFrame, piece_rows: int, piece_chars: int) -> DataFrame:
    """Cut range-sorted rows (conv, turn, role, text, id, mark, copies) into pieces."""
    conv = rows.schema["conv"]
    schema = T.StructType([conv, *T.StructType.fromDDL(PIECE).fields])

    def cut(batches):
        part = TaskContext.get().partitionId()
        types = {}

        def made():
            nothing = object()
            now, seq, chars, first, cut_off = nothing, 0, 0, True, False
            held: list = []

            def piece(several: bool):
                seen: set = set()
                inits, faults, ids = [], [], []
                for _, role, _, key, mark in held:
                    fault = "b" if mark == "b" else "d" if key in seen else mark
                    seen.add(key)
                    inits.append(initial(role))
                    faults.append(fault)
                    ids.append(None if fault in "bd" else key)
                turns = sorted({h[0] for h in held if h[0] is not None})
                i, f = "".join(inits), "".join(faults)
                low, high = (turns[0], turns[-1]) if turns else (None, None)
                return (now, part, seq, several, i, f, symbols_of(i, f), low, high, len(turns), ids if several else None, [h[1] for h in held], [h[2] for h in held])

            for c, turn, role, text, key, mark, copies in _rows(batches_typed(batches, types)):
                if now is nothing or c != now:
                    if now is not nothing:
                        yield piece(first or cut_off)
                        first = False
                    # Numbers run on through a partition, so (part, seq) names a piece.
                    now, seq, chars, held, cut_off = c, seq + 1, 0, [], False
                for _ in range(copies):
                    if held and (len(held) >= piece_rows or chars + len(text) > piece_chars):
                        yield piece(True)
                        seq, chars, held, cut_off = seq + 1, 0, [], True
                    held.append((turn, role, text, key, mark))
                    chars += len(text)
            if now is not nothing:
                yield piece(True)

        def batches_typed(bs, into):
            for b in bs:
                into.setdefault("conv", b.schema.field(0).type)
                yield b

        rows_of = made()
        head = next(rows_of, None)
        if head is None:
            return

        def again():
            yield head
            yield from rows_of

        s, i, n = pa.string(), pa.int32(), pa.int64()
        kinds = [types["conv"], i, i, pa.bool_(), s, s, s, n, n, n, pa.list_(pa.binary()), pa.list_(s), pa.list_(s)]
        yield from _batches(again(), pa.schema([pa.field(f.name, t) for f, t in zip(schema.fields, kinds)]))

    return rows.mapInArrow(cut, schema)


class Told:
    """A conversation while its pieces come along in order: counts, its hash, its state."""

    def __init__(self, conv):
        self.conv = conv
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.last = ""
        self.audit: list[str] = []
        self.hash, self.place, self.state = hashlib.sha256(), 0, 0

    def count(self, inits: str, faults: str, low, high, turns: int):
        if low is not None:
            self.turns += turns - (1 if self.high == low else 0)
            self.low = low if self.low is None else self.low
            self.high = high
        self.blank += faults.count("b")
        self.duplicate += faults.count("d")
        self.truncated += faults.count("t")
        chain = self.last + inits
        self.illegal += sum(a + b not in LEGAL for a, b in zip(chain, chain[1:]))
        self.last = chain[-1:]

    def edit(self, segment: str, roles: list[str], texts: list[str], inits: str) -> list[tuple[int, str, str]]:
        """Carry out a segment of the audit on a piece's rows; returns the repaired rows."""
        out, at = [], 0
        for e in segment:
            wanted = "assistant" if self.state == 2 else "user"
            if e == "I":
                role, text, step = wanted, "", wanted[0]
            else:
                role, text, step = roles[at], texts[at], inits[at]
                at += 1
                if e == "D":
                    continue
                if e == "R":
                    role, step = wanted, wanted[0]
            self.state = STEP[self.state, step]
            self.hash.update((("\n" if self.place else "") + f"{role}:{text}").encode())
            out.append((self.place, role, text))
            self.place += 1
        self.audit.append(segment)
        return out

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string"
SUMMARY_ARROW = [pa.int64()] * 6 + [pa.string()] * 2
TURNS_ARROW = [pa.int64(), pa.string(), pa.string()]


def finish(vector: list) -> tuple[int, str]:
    """(cost, audit) of a whole conversation from the vector after its last row."""
    cost, rope = best((v[0] + INSERT * CLOSING[s], join(v[1], "I" * CLOSING[s])) for s, v in enumerate(vector) if v)
    return cost, text_of(rope)


def _outputs(conv: T.StructField, whole_turns: bool):
    spark_type = T.StructType([conv, *T.StructType.fromDDL(TURNS if whole_turns else SUMMARY).fields])
    kinds = TURNS_ARROW if whole_turns else SUMMARY_ARROW
    return spark_type, lambda conv_type: pa.schema([pa.field(f.name, t) for f, t in zip(spark_type.fields, [conv_type, *kinds])])


def _in_one_piece(pieces: DataFrame, grammar: Grammar, whole_turns: bool) -> DataFrame:
    spark_type, arrow_type = _outputs(pieces.schema["conv"], whole_turns)

    def run(batches):
        known: dict[str, tuple[int, str]] = {}

        def told(b):
            for conv, inits, faults, symbols, low, high, turns, roles, texts in _rows([b]):
                if symbols not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[symbols] = finish(grammar.run(symbols, START))
                t = Told(conv)
                t.count(inits, faults, low, high, turns)
                t.cost, audit = known[symbols]
                made = t.edit(audit, roles, texts, inits)
                if whole_turns:
                    yield from ((conv, *m) for m in made)
                else:
                    yield t.row()

        for b in batches:
            yield from _batches(told(b), arrow_type(b.schema.field(0).type))

    columns = "conv", "inits", "faults", "symbols", "turn_low", "turn_high", "turns", "roles", "texts"
    return pieces.where(~F.col("several")).select(*columns).mapInArrow(run, spark_type)


def _said_before(pieces: DataFrame) -> DataFrame:
    """(part, seq, again): places of rows that an earlier piece of the conversation holds, blanks aside."""
    ids = pieces.where("several").select("conv", "part", "seq", F.posexplode("ids").alias("at", "id")).where("id is not null")
    order = F.row_number().over(W.partitionBy("conv", "id").orderBy("part", "seq"))
    return ids.withColumn("n", order).where("n > 1").groupBy("part", "seq").agg(F.collect_list("at").alias("again"))


def _segments(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """(conv, part, seq, faults, cost, segment) of the pieces of conversations in several pieces.

    First every piece's matrix is worked out where it stands; then a conversation's matrices
    come along in order and its audit is dealt out to its pieces.
    """
    conv = pieces.schema["conv"]
    narrow = pieces.where("several").select("conv", "part", "seq", "inits", "faults").join(_said_before(pieces), ["part", "seq"], "left")
    narrow = narrow.select("conv", "part", "seq", "inits", "faults", "again")
    mid = T.StructType([conv, *T.StructType.fromDDL("part int, seq int, faults string, costs array<long>, audits array<string>").fields])
    out = T.StructType([conv, *T.StructType.fromDDL("part int, seq int, faults string, cost long, segment string").fields])
    i, n, s = pa.int32(), pa.int64(), pa.string()

    def matrices(batches):
        def made(b):
            for conv, part, seq, inits, faults, again in _rows([b]):
                if again:
                    gone = set(again)
                    faults = "".join("d" if k in gone else f for k, f in enumerate(faults))
                m = grammar.run(symbols_of(inits, faults), ONE)
                yield conv, part, seq, faults, [e and e[0] for e in m], [e and text_of(e[1]) for e in m]

        for b in batches:
            yield from _batches(made(b), pa.schema([pa.field(f.name, t) for f, t in zip(mid.fields, [b.schema.field(0).type, i, i, s, pa.list_(n), pa.list_(s)])]), at_once=64)

    def deal(batches):
        types: dict = {}

        def noted():
            for b in batches:
                types.setdefault("conv", b.schema.field(0).type)
                yield b

        def dealt(conv, held, vector):
            cost, audit = finish(vector)
            at = 0
            for k, (part, seq, faults) in enumerate(held):
                end, left = at, len(faults)
                while left:
                    left -= audit[end] != "I"
                    end += 1
                end = len(audit) if k == len(held) - 1 else end
                yield conv, part, seq, faults, cost, audit[at:end]
                at = end

        def made():
            held, vector, now = [], START, None
            for conv, part, seq, faults, costs, audits in _rows(noted()):
                if held and conv != now:
                    yield from dealt(now, held, vector)
                    held, vector = [], START
                now = conv
                held.append((part, seq, faults))
                vector = product(vector, [None if c is None else (c, a) for c, a in zip(costs, audits)])
            if held:
                yield from dealt(now, held, vector)

        rows = made()
        head = next(rows, None)
        if head is not None:
            yield from _batches(_after(head, rows), pa.schema([pa.field(f.name, t) for f, t in zip(out.fields, [types["conv"], i, i, s, n, s])]))

    return narrow.mapInArrow(matrices, mid).repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(deal, out)


def _after(head, rows):
    yield head
    yield from rows


def _in_several_pieces(pieces: DataFrame, grammar: Grammar, whole_turns: bool) -> DataFrame:
    """Segments and texts of each conversation meet in order; a piece is all that is held at once."""
    spark_type, arrow_type = _outputs(pieces.schema["conv"], whole_turns)
    texts = pieces.where("several").select("conv", "part", "seq", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("string").alias("faults"), "inits", "turn_low", "turn_high", "turns", "roles", "texts")
    segments = _segments(pieces, grammar).select("conv", "part", "seq", F.lit(0).alias("kind"), "cost", "segment", "faults", *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("inits", "turn_low", "turn_high", "turns", "roles", "texts")))

    def run(batches):
        types: dict = {}

        def noted():
            for b in batches:
                types.setdefault("conv", b.schema.field(0).type)
                yield b

        def made():
            t, own = None, None
            for conv, _, _, kind, cost, segment, faults, inits, low, high, turns, roles, said in _rows(noted()):
                if t is None or conv != t.conv:
                    if t is not None and not whole_turns:
                        yield t.row()
                    t = Told(conv)
                if kind == 0:
                    own, t.cost = (segment, faults), cost
                    continue
                t.count(inits, own[1], low, high, turns)
                rows = t.edit(own[0], roles, said, inits)
                if whole_turns:
                    yield from ((conv, *m) for m in rows)
            if t is not None and not whole_turns:
                yield t.row()

        rows = made()
        head = next(rows, None)
        if head is not None:
            yield from _batches(_after(head, rows), arrow_type(types["conv"]))

    return segments.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "part", "seq", "kind").mapInArrow(run, spark_type)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, whole_turns: bool = False, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS, max_rules: int = MAX_RULES) -> DataFrame:
    """Repair every conversation of a table of turns.

    Returns a row per conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256; or, with ``whole_turns``, the repaired turns (``conv``, place, role,
    text).  ``copies`` says how often a row stands there (once, if not given); a conversation
    whose rows stand there 0 times is returned with zeros, an empty audit and the hash of
    nothing.

    Rows are taken by turn, nulls first, rows of one turn by role and then by the MD5 of role and
    text; rows alike in all stand side by side, the later ones as duplicates.  A null role or
    text is one space; a null conversation is a conversation of its own.  A role whose first
    letter is none of s, u, a (an empty one too) fits nowhere: it is given a new role or
    deleted.  Other columns are left out.  An empty table gives an empty result.
    """
    r, t = F.coalesce(F.col(role).cast("string"), F.lit(" ")), F.coalesce(F.col(text).cast("string"), F.lit(" "))
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), r.alias("role"), t.alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    body = F.rtrim("text", F.lit(WHITE))
    mark = F.when(body == "", "b").when(F.substring(body, -1, 1).isin(".", "!", "?"), "c").otherwise("t")
    key = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")))
    base = base.select("conv", "turn", "role", "text", key.alias("id"), mark.alias("mark"), "copies")
    # The last key splits even rows that are alike in everything.
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("id").asc(), F.col("row").asc()]
    ranged = base.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    pieces = stored(_pieces(ranged, piece_rows, piece_chars), "talk-pieces", compression="zstd")
    sequences = stored(pieces.where(F.length("symbols") > 1).groupBy("symbols").agg(F.count("*").alias("n")), "talk-sequences")
    grammar = learn(sequences, max_rules)
    out = _in_one_piece(pieces, grammar, whole_turns).unionByName(_in_several_pieces(pieces, grammar, whole_turns))
    return out.withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) damaged by the CRC-32 of ``conv:turn``; nulls are one space."""
    space = F.lit(" ")
    said = F.coalesce(F.col(text), space)
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    return rows.select(
        F.col(conv), F.col(turn),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), space)).alias(role),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_repair(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), copies=F.col("copies"))


#: DuckDB has no CRC-32: a table of 256 steps, and a fold over the bytes of a key.
CRC_SQL = """tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) q(i)))"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes, where ``tab`` is at hand."""
    byte = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {crc_sql('key')} % 20 AS h FROM src, tab),
bad AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(CAST(length(role) AS VARCHAR) || ':' || role || ':' || text), copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM bad),
two AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM ord),
flt AS (SELECT conv_id, turn, role, text, n, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'c' END AS fault,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS ini FROM two),
lnk AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY n) || ini AS pair, count(*) OVER (PARTITION BY conv_id) AS size FROM flt),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lnk GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')) v(a, b, c, e)),
kept AS (SELECT * FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)) v(ini, b, d)),
edt AS (SELECT ini, fault, b, d, e, c + CASE WHEN fault = 't' AND e <> 'D' THEN 5 ELSE 0 END AS c FROM (
  SELECT i.ini, b, b AS d, 'D' AS e, 2 AS c FROM (VALUES ('s'), ('u'), ('a'), ('o')) i(ini), (VALUES (0), (1), (2), (3)) s(b)
  UNION ALL SELECT ini, b, d, 'K', 0 FROM kept UNION ALL SELECT i.ini, b, d, 'R', 1 FROM (VALUES ('s'), ('u'), ('a'), ('o')) i(ini), kept k WHERE k.ini <> 's') o, (VALUES ('b'), ('d'), ('t'), ('c')) f(fault)
  WHERE e = 'D' OR fault IN ('t', 'c')),
moves AS (SELECT ini, fault, a, d, min(ROW(i.c + x.c, i.e || x.e)) AS m FROM ins i JOIN edt x USING (b) GROUP BY ALL),
dp AS (SELECT conv_id, 0::BIGINT AS n, size, 0 AS s, 0 AS cost, '' AS audit FROM lnk GROUP BY conv_id, size
  UNION ALL
  SELECT conv_id, n, size, s, m[1], m[2] FROM (SELECT r.conv_id, r.n, r.size, v.d AS s, min(ROW(dp.cost + v.m[1], dp.audit || v.m[2])) AS m FROM dp JOIN lnk r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.n = dp.n + 1
    JOIN moves v ON v.ini = r.ini AND v.fault = r.fault AND v.a = dp.s GROUP BY r.conv_id, r.n, r.size, v.d)),
won AS (SELECT conv_id, min(ROW(cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END)) AS m FROM dp WHERE n = size GROUP BY conv_id),
ltr AS (SELECT conv_id, m[2] AS audit, unnest(range(1, length(m[2]) + 1)) AS p FROM won),
act AS (SELECT conv_id, p, substr(audit, CAST(p AS INTEGER), 1) AS e, length(replace(left(audit, CAST(p AS INTEGER)), 'I', '')) AS n, length(replace(left(audit, CAST(p AS INTEGER)), 'D', '')) AS pos FROM ltr),
rep AS (SELECT a.conv_id, a.p, a.e, a.pos, f.role, f.text, f.ini FROM act a LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.n = a.n AND a.e <> 'I' WHERE a.e <> 'D'),
shf AS (SELECT *, max(CASE WHEN pos = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM rep),
txt AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (pos - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole FROM shf GROUP BY conv_id)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(w.m[1], 0) AS BIGINT) AS cost, coalesce(w.m[2], '') AS audit, sha256(coalesce(x.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN cnt c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN txt x ON x.conv_id IS NOT DISTINCT FROM i.conv_id
"""
