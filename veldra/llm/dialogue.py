"""Conversation structure repair: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``.

Each row has a letter: its role's initial and its first fault. The letters of a conversation are its signature.
Signatures are inserted, sorted, into a prefix trie whose nodes hold a layer of the dynamic program, so that a prefix
which conversations share is computed once; the node at which a signature ends gives its answer.

A layer has, for each state of the grammar, the cheapest cost of the rows so far, the audit (edit letters) as a chain of
steps, and the audit's place among those of the layer. Inserts belong to the row that follows them, so no audit of a
layer is the beginning of another one, and places decide between equal costs without comparing whole audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veldra.llm.textcodes import bounded_batches
from veldra.operators.windows import numbered
from veldra.storage import Scratch

#: Rows of a conversation that one task takes at once; a longer conversation is cut into pieces of so many rows.
PIECE = 20_000
#: Nodes of a task's trie, at most, before it starts anew.
NODES = 1 << 19
#: Conversations of more than PIECE rows that are broadcast by id (16 MB); more are joined.
BROADCAST_IDS = 1 << 20
WHITE = " \t\n\v\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an insert or a rerole gives in each state, and the state after it.
FOLLOWING = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Inserts that may precede a row, by the state before them: (how many, state after them). More would run in a circle.
INSERTS = {START: ((0, START), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
#: Inserts that complete a conversation.
COMPLETING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1

#: Letter of a row that must go; other letters are s, u, a or x, in upper case where the text is truncated.
GONE = "d"


def _edits(letter: str) -> dict[int, tuple[tuple[str, int, int], ...]]:
    """State -> (audit letters, cost, next state) of all ways to get past a row of this letter."""
    initial, extra = letter.lower(), TRUNCATED_COST * letter.isupper()
    out = {}
    for before, ways in INSERTS.items():
        found = []
        for n, state in ways:
            lead, cost = "I" * n, INSERT_COST * n
            found.append((lead + "D", cost + DELETE_COST, state))
            if letter != GONE:
                found.append((lead + "R", cost + REROLE_COST + extra, FOLLOWING[state][1]))
                if (state, initial) in KEPT:
                    found.append((lead + "K", cost + extra, KEPT[state, initial]))
        out[before] = tuple(found)
    return out


EDITS = {letter: _edits(letter) for letter in "suaxSUAX" + GONE}

#: (cost, place, chain) of each state, or None; a chain is (the chain before it, letters).
Layer = tuple


def begin(state: int = START) -> Layer:
    return tuple((0, 0, None) if s == state else None for s in range(4))


def advance(layer: Layer, letter: str) -> Layer:
    """The layer after one more row."""
    best: list = [None] * 4
    for before, ways in EDITS[letter].items():
        if layer[before] is None:
            continue
        cost, place, chain = layer[before]
        for letters, extra, after in ways:
            key = (cost + extra, place, letters)
            if best[after] is None or key < best[after][0]:
                best[after] = (key, (chain, letters))
    order = sorted(b[0][1:] for b in best if b)
    return tuple(b and (b[0][0], order.index(b[0][1:]), b[1]) for b in best)


def spelled(chain) -> str:
    parts = []
    while chain is not None:
        chain, letters = chain
        parts.append(letters)
    return "".join(reversed(parts))


def finish(layer: Layer) -> tuple[int, str]:
    """(cost, audit) of the conversation that ends here."""
    cost, _, more, chain = min((x[0] + INSERT_COST * COMPLETING[s], x[1], "I" * COMPLETING[s], x[2] or ()) for s, x in enumerate(layer) if x is not None)
    return cost, spelled(chain or None) + more


class Trie:
    """Signatures by prefix; a node is [layer, children, answer]."""

    def __init__(self):
        self.root, self.nodes = [begin(), {}, None], 1

    def answers(self, signatures: Iterable[str]) -> dict[str, tuple[int, str]]:
        """Signature -> (cost, audit)."""
        out = {}
        for s in sorted(set(signatures)):
            if self.nodes > NODES:
                self.__init__()
            node = self.root
            for letter in s:
                child = node[1].get(letter)
                if child is None:
                    child = node[1][letter] = [advance(node[0], letter), {}, None]
                    self.nodes += 1
                node = child
            if node[2] is None:
                node[2] = finish(node[0])
            out[s] = node[2]
        return out


def applied(roles: list[str], texts: list[str], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The (role, text) rows that the edits of an audit leave."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            role, state = FOLLOWING[state]
            out.append((role, ""))
            continue
        if edit == "R":
            role, state = FOLLOWING[state]
            out.append((role, texts[i]))
        elif edit == "K":
            out.append((roles[i], texts[i]))
            state = KEPT[state, roles[i][:1]]
        i += 1
    return out


def signature(roles: list[str], texts: list[str]) -> tuple[str, int, int, int]:
    """(letters, blank, duplicate, truncated) of a conversation's rows in order."""
    letters, counts, seen = [], [0, 0, 0], set()
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(WHITE)[-1:]
        fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        letters.append(GONE if fault in (0, 1) else letter.upper() if fault == 2 else letter)
    return "".join(letters), *counts


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations; the rows of one follow each other, in several batches perhaps."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = t["conv"]
        last = key[len(key) - 1]
        same = pc.is_null(key) if not last.is_valid else pc.fill_null(pc.equal(key, last), False)
        n = pc.sum(pc.cast(same, pa.int64())).as_py()  # rows are sorted, so these are the last ones
        head, tail = t.slice(0, len(t) - n), t.slice(len(t) - n)
        if len(head) or (held and held[-1]["conv"][0] != last):
            yield pa.concat_tables([*held, head])
            held = []
        held.append(tail)
    if held:
        yield pa.concat_tables(held)


def _repaired(conv_type: pa.DataType):
    """Rows sorted by conversation -> a row for each conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for t in _conversations(batches):
            conv, turn, role, text, present = (t[c].combine_chunks() for c in ("conv", "turn", "role", "text", "present"))
            keys = conv.to_pylist()
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            turn, role, text, present = turn.to_pylist(), role.to_pylist(), text.to_pylist(), present.to_pylist()
            found = []
            for a, b in zip(starts, starts[1:], strict=False):
                at = [i for i in range(a, b) if present[i]]
                roles, texts, turns = [role[i] for i in at], [text[i] for i in at], {turn[i] for i in at} - {None}
                gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
                found.append((keys[a], gaps, roles, texts, *signature(roles, texts)))
            answers = trie.answers(f[4] for f in found)
            columns = [
                pa.array([f[0] for f in found], conv_type),
                pa.array([f[1] for f in found], pa.int64()),
                *(pa.array([f[i] for f in found], pa.int64()) for i in (5, 6, 7)),
                pa.array([illegal_pairs(f[2]) for f in found], pa.int64()),
                pa.array([answers[f[4]][0] for f in found], pa.int64()),
                pa.array([answers[f[4]][1] for f in found], pa.string()),
                pa.array([[{"role": r, "text": x} for r, x in applied(f[2], f[3], answers[f[4]][1])] for f in found], _TURNS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])

    return run


@dataclass
class Repair:
    """``reports``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation.

    ``whole``: the reports of conversations of at most PIECE rows with ``repaired``, an array of (role, text).
    ``long_reports`` and ``long_turns``: of the others, and (conv, position, role, text) of their repaired rows.
    """

    whole: DataFrame
    long_reports: DataFrame | None = None
    long_turns: DataFrame | None = None

    @property
    def reports(self) -> DataFrame:
        out = self.whole.drop("repaired")
        return out if self.long_reports is None else out.unionByName(self.long_reports)

    @property
    def turns(self) -> DataFrame:
        out = self.whole.select("conv", F.posexplode("repaired").alias("position", "_t")).select("conv", F.col("position").cast("long").alias("position"), "_t.role", "_t.text")
        return out if self.long_turns is None else out.unionByName(self.long_turns)


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None = None, piece: int = PIECE) -> Repair:
    """Repair every conversation of ``df``; other columns are left out and may have any names.

    Rows are in the order of ``turn`` (null first), then of role and text, so equal turns and repeated rows have one
    defined order. A null role or text is one space. Rows whose ``present`` is not true only name their conversation: one
    without other rows has zeros and an empty audit. A null conversation id is a conversation of its own. An empty table
    gives empty results. The first character of a role is its initial, as it stands; roles other than s, u and a can't
    be kept. Conversations of more than ``piece`` rows are repaired in pieces, with the same result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    c = lambda name: F.col(f"`{name}`")
    there = F.coalesce(c(present), F.lit(False)) if present else F.lit(True)
    rows = df.select(c(conv).alias("conv"), c(turn).cast("long").alias("turn"), F.coalesce(c(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(c(text).cast("string"), F.lit(" ")).alias("text"), there.alias("present"))
    rows = rows.withColumns({x: F.when(F.col("present"), F.col(x)) for x in ("turn", "role", "text")})
    kind = rows.schema["conv"].dataType
    long_ids = rows.groupBy("conv").count().where(F.col("count") > piece).select(F.col("conv").alias("_long"))
    n = long_ids.count()
    short = rows
    if n:
        ids = F.broadcast(long_ids) if n <= BROADCAST_IDS else long_ids
        short = rows.join(ids, rows["conv"].eqNullSafe(F.col("_long")), "left_anti")
    placed = short.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    whole = placed.mapInArrow(_repaired(to_arrow_type(kind)), _schema(kind, f"{_REPORT}, repaired array<struct<role:string,text:string>>"))
    if not n:
        return Repair(whole)
    return Repair(whole, *_in_pieces(rows.join(ids, rows["conv"].eqNullSafe(F.col("_long")), "left_semi"), kind, piece))


# --- long conversations -------------------------------------------------------------------------------------------


def _schema(conv_type: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv_type), *T._parse_datatype_string(rest).fields])


def _piece_ways(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest (cost, audit) between every two states for each piece, by the same dynamic program."""
    kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        ways = []
        for letters in batch["letters"].to_pylist():
            found = []
            for before in range(4):
                layer = begin(before)
                for letter in letters:
                    layer = advance(layer, letter)
                found += [{"before": before, "after": s, "cost": x[0], "audit": spelled(x[2])} for s, x in enumerate(layer) if x is not None]
            ways.append(found)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv", "piece", "first_n", "letters")), pa.array(ways, kind)], ["conv", "piece", "first_n", "letters", "ways"])


def _chained(conv_type: pa.DataType):
    """Pieces sorted by conversation and piece -> (conv, cost, audit, steps): the cheapest way through all of them."""
    step = pa.struct([("first_n", pa.int64()), ("state", pa.int32()), ("letters", pa.string()), ("audit", pa.string())])

    def ended(conv, layer, steps) -> pa.RecordBatch:
        cost, _, more, at = min((x[0] + INSERT_COST * COMPLETING[s], x[1], "I" * COMPLETING[s], s) for s, x in enumerate(layer) if x is not None)
        chain, taken = layer[at][2], []
        while chain is not None:
            chain, entry = chain
            taken.append(entry)
        taken.reverse()
        taken[-1] = (taken[-1][0], taken[-1][1] + more)
        out = [{"first_n": n, "state": state, "letters": letters, "audit": audit} for (n, letters), (state, audit) in zip(steps, taken, strict=True)]
        columns = [pa.array([conv], conv_type), pa.array([cost], pa.int64()), pa.array(["".join(x["audit"] for x in out)], pa.string()), pa.array([out], pa.list_(step))]
        return pa.RecordBatch.from_arrays(columns, ["conv", "cost", "audit", "steps"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, layer, steps = None, None, []
        for batch in batches:
            for conv, n, letters, ways in zip(*(batch[c].to_pylist() for c in ("conv", "first_n", "letters", "ways")), strict=True):
                if layer is None or conv != now:
                    if layer is not None:
                        yield ended(now, layer, steps)
                    now, layer, steps = conv, begin(), []
                steps.append((n, letters))
                best: list = [None] * 4
                for w in ways:
                    if layer[w["before"]] is not None:
                        cost, place, chain = layer[w["before"]]
                        key = (cost + w["cost"], place, w["audit"])
                        if best[w["after"]] is None or key < best[w["after"]][0]:
                            best[w["after"]] = (key, (chain, (w["before"], w["audit"])))
                order = sorted(b[0][1:] for b in best if b)
                layer = tuple(b and (b[0][0], order.index(b[0][1:]), b[1]) for b in best)
        if layer is not None:
            yield ended(now, layer, steps)

    return run


def _row_edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row number, roles inserted before it, whether it stays, its new role if it gets one, roles inserted after it) of each row."""
    kinds = (pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.list_(pa.string()))
    for batch in batches:
        for n, state, letters, audit in zip(*(batch[c].to_pylist() for c in ("first_n", "state", "letters", "audit")), strict=True):
            out, lead = [], []
            for edit in audit:
                role = None
                if edit == "K":
                    state = KEPT[state, letters[len(out)].lower()]
                elif edit != "D":
                    role, state = FOLLOWING[state]
                if edit == "I":
                    lead.append(role)
                else:
                    out.append([n + len(out), lead, edit != "D", role, []])
                    lead = []
            out[-1][4] = lead
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["edit_n", "lead", "stays", "new_role", "trail"])


def _in_pieces(rows: DataFrame, kind: T.DataType, piece: int) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired rows of long conversations; none is gathered in one task but as letters of its rows."""
    scratch = Scratch(rows.sparkSession, "dialogue")
    ids = rows.select("conv").distinct()
    order = [F.col(c) for c in ("conv", "turn", "role", "text")]
    ranked = scratch.keep(numbered(rows.where("present").drop("present"), order, "n").withColumn("same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)), "ranked")
    base = ranked.groupBy("conv").agg(F.min("n").alias("_base"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).withColumnRenamed("conv", "_c")
    seen = ranked.groupBy("conv", "same").agg(F.min("n").alias("_first")).select(F.col("conv").alias("_s"), F.col("same").alias("_same"), "_first")
    end = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    known = ranked.select("conv", "n", "same", initial.alias("initial"), letter.alias("letter"), end.alias("end"))
    known = known.join(seen, known["conv"].eqNullSafe(F.col("_s")) & (F.col("same") == F.col("_same")))
    known = known.withColumn("fault", F.when(F.col("end") == "", "blank").when(F.col("n") > F.col("_first"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated"))
    known = known.join(F.broadcast(base.select("_c", "_base")), F.col("conv").eqNullSafe(F.col("_c")))  # a row for each long conversation
    known = known.withColumn("piece", F.floor((F.col("n") - F.col("_base")) / piece)).withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault").isNotNull(), F.upper("letter")).otherwise(F.col("letter")))
    sorted_rows = F.array_sort(F.collect_list(F.struct("n", "letter", "initial")))
    tally = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    pieces = known.groupBy("conv", "piece").agg(sorted_rows.alias("r"), *tally)  # piece rows at most
    initials = F.transform("r", lambda x: x["initial"])
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), lambda a, b: F.concat(a, b))
    wrong = lambda c: (~c.isin("su", "ua", "au")).cast("long")
    pieces = pieces.select("conv", "piece", "blank", "duplicate", "truncated", F.col("r")[0]["n"].alias("first_n"), F.array_join(F.transform("r", lambda x: x["letter"]), "").alias("letters"), F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("inside"), F.element_at(initials, 1).alias("head"), F.element_at(initials, -1).alias("tail"))
    pieces = scratch.keep(pieces, "pieces")
    joints = F.array_sort(F.collect_list(F.struct("piece", "head", "tail")))
    counted = pieces.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum("inside").alias("_inside"), joints.alias("_j"))
    between = F.zip_with(F.slice("_j", 1, F.size("_j") - 1), F.slice("_j", 2, F.size("_j")), lambda a, b: wrong(F.concat(a["tail"], b["head"])))
    counted = counted.select("conv", "blank", "duplicate", "truncated", (F.col("_inside") + F.aggregate(between, F.lit(0).cast("long"), lambda a, x: a + x)).alias("illegal"))
    ways = pieces.select("conv", "piece", "first_n", "letters").mapInArrow(_piece_ways, _schema(kind, "piece long, first_n long, letters string, ways array<struct<before:int,after:int,cost:long,audit:string>>"))
    line = ways.repartition("conv").sortWithinPartitions("conv", "piece")
    chosen = scratch.keep(line.mapInArrow(_chained(to_arrow_type(kind)), _schema(kind, "cost long, audit string, steps array<struct<first_n:long,state:int,letters:string,audit:string>>")), "chosen")
    k = lambda df, name: df.withColumnRenamed("conv", name)
    reports = ids.join(k(counted, "_k"), ids["conv"].eqNullSafe(F.col("_k")), "left").join(base.select("_c", "gaps"), F.col("conv").eqNullSafe(F.col("_c")), "left").join(k(chosen.drop("steps"), "_h"), F.col("conv").eqNullSafe(F.col("_h")), "left")
    reports = reports.select("conv", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    edits = chosen.select(F.explode("steps").alias("s")).select("s.*").repartition("first_n").mapInArrow(_row_edits, "edit_n long, lead array<string>, stays boolean, new_role string, trail array<string>")
    out = ranked.join(edits, F.col("n") == F.col("edit_n"))
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("stays"), F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    turns = out.select("conv", "n", F.posexplode(F.concat(empty("lead"), own, empty("trail"))).alias("_p", "_t"))
    return reports, turns.select("conv", (F.col("n") * 8 + F.col("_p")).alias("position"), "_t.role", "_t.text")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` lines joined by newlines, in the order of ``position``, read row by row.

    A hash is a chain, so one task reads the rows of a conversation; it holds one batch of them.
    """
    kind = turns.schema["conv"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([h.hexdigest()], pa.string())], ["conv", "sha256"])
        for batch in batches:
            for conv, role, text in zip(batch["conv"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if h is None or conv != now:
                    if h is not None:
                        yield row()
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if h is not None:
            yield row()

    return turns.repartition("conv").sortWithinPartitions("conv", "position").mapInArrow(run, _schema(kind, "sha256 string"))
