"""Conversations as token sequences: turns that several of them begin with are emitted once."""

import base64
import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.worker import worker_cached
from guestlens.llm.common import totals_before
from guestlens.session import stage

# Control strings of the template, in order of their token ids behind the vocabulary's.
BEGIN, END = "<s>", "</s>"
USER = ("[INST]", "[/INST]")
SYSTEM = ("<<SYS>>", "<</SYS>>")
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROLS = (BEGIN, END, *USER, *SYSTEM, *OTHER)
# A control string in a text gets a backslash behind its first character, and so does one
# that has backslashes there already; one backslash less is the way back.
_RESTS = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}))
_ESCAPED = rf"([<\[])(\\*)({_RESTS})"
_UNESCAPED = rf"([<\[])\\(\\*)({_RESTS})"
_TURN = "|".join(rf"{re.escape(a)}.*?{re.escape(b)}" for a, b in (USER, SYSTEM, (OTHER[0], OTHER[2])))
_TURN = rf"(?s){_TURN}|.*?{re.escape(END)}"
# Characters that are encoded at a time; the pieces of a text decode to the text.
_BLOCK = 8192
# Shared turns whose digests may be broadcast, about 80 bytes each.
_BROADCAST_TURNS = 200_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPED, "$1$2$3")


def marks(role: Column) -> tuple[Column, Column]:
    """What stands before and after a turn's text. A role of neither user, assistant nor
    system is named."""
    before = F.when(role == "user", USER[0]).when(role == "assistant", "").when(role == "system", SYSTEM[0])
    after = F.when(role == "user", USER[1]).when(role == "assistant", END).when(role == "system", SYSTEM[1])
    return before.otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))), after.otherwise(OTHER[2])


class TurnEncoder:
    """Tokens of a byte-level vocabulary, and one for each control string."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        first = max(merges.values()) + 1
        self.controls = {c: first + i for i, c in enumerate(CONTROLS)}
        self.coder = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=merges, special_tokens=self.controls)
        self.split = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")").split

    def plain(self, text: str) -> list[int]:
        """Tokens of a text, whatever control strings it may hold."""
        return [i for at in range(0, len(text), _BLOCK) for i in self.coder.encode_ordinary(text[at : at + _BLOCK])]

    def marked(self, mark: str) -> list[int]:
        return [i for part in self.split(mark) if part for i in ([self.controls[part]] if part in self.controls else self.plain(part))]

    def text(self, ids: list[int]) -> str:
        return self.coder.decode_bytes(ids).decode()


def _coder(tokenizer: str, pattern: str):
    """A function for tasks that gives the encoder of a vocabulary file on the driver; the
    file is sent with the job."""
    with open(tokenizer, "rb") as file:
        ranks = file.read()
    name = sha256(ranks + pattern.encode()).hexdigest()
    return lambda: worker_cached(("turns", name), lambda: TurnEncoder(ranks, pattern))


def _chained(turns: DataFrame) -> DataFrame:
    """Adds to `turns` (conv, turn, role, text): place, from 0 in a conversation; prefix, a
    digest of all its turns so far; up, the prefix before this turn. Two conversations that
    begin with the same turns have the same prefixes. One digest is carried from row to row."""
    own = F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)).cast("binary"), 256).alias("_own")
    ordered = turns.select("*", own).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def chain(batches):
        import pyarrow as pa

        conv, place, prefix = None, 0, ""
        for batch in batches:
            places, prefixes, ups = [], [], []
            for now, digest in zip(batch.column("conv").to_pylist(), batch.column("_own").to_pylist()):
                conv, place, prefix = (now, place + 1, prefix) if now == conv else (now, 0, "")
                ups.append(prefix or None)
                prefix = sha256((prefix + digest).encode()).hexdigest()
                places.append(place)
                prefixes.append(prefix)
            kept = [batch.column(c) for c in ("conv", "conv_id", "role", "text")]
            columns = [*kept, pa.array(places, pa.int64()), pa.array(prefixes, pa.string()), pa.array(ups, pa.string())]
            yield pa.record_batch(columns, ["conv", "conv_id", "role", "text", "place", "prefix", "up"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(chain, f"conv string, conv_id {kind}, role string, text string, place long, prefix string, up string")


def _tokens(own: DataFrame, coder) -> DataFrame:
    """The emitted turns with tokens and the part of them that is under the loss."""
    before, after = marks(F.col("role"))
    before = F.when(F.col("place") == 0, F.concat(F.lit(BEGIN), before)).otherwise(before)
    given = own.select("conv", "place", "prefix", "up", before.alias("before"), escape(F.col("text")).alias("text"), after.alias("after"), (F.col("role") == "assistant").alias("loss"))

    def encode(batches):
        import pyarrow as pa

        encoder = coder()
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                tokens, spans = [], []
                for before, text, after, loss in zip(*(rows.column(c).to_pylist() for c in ("before", "text", "after", "loss"))):
                    first, middle = encoder.marked(before), encoder.plain(text)
                    tokens.append(first + middle + encoder.marked(after))
                    spans.append((len(first), len(first) + len(middle)) if loss else (0, 0))
                columns = [rows.column(c) for c in ("conv", "place", "prefix", "up")]
                columns += [pa.array(tokens, pa.list_(pa.int32())), *(pa.array(s, pa.int64()) for s in zip(*spans))]
                yield pa.record_batch(columns, ["conv", "place", "prefix", "up", "tokens", "loss_start", "loss_end"])

    return given.mapInArrow(encode, "conv string, place long, prefix string, up string, tokens array<int>, loss_start long, loss_end long")


def _paths(branches: DataFrame, attached: DataFrame) -> DataFrame:
    """(conv, path) of every branch: the steps from its tree's first branch to itself, each
    with the branch that it leaves (`parent`), behind how many turns (`behind`) and tokens
    (`tokens`). Paths double each round, so depth d takes log2(d) rounds; branches without
    parent and children need none."""
    step = F.array(F.struct((-F.col("behind")).alias("later"), "conv", "parent", "tokens"))
    below = attached.select("conv", step.alias("path"), F.col("parent").alias("above"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("later"), "conv", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("tokens")))
    first = branches.where(F.col("up").isNull()).select("conv", none.alias("path"), F.lit(None).cast("string").alias("above"))
    parents = stage(first.join(attached.select(F.col("parent").alias("conv")).distinct(), "conv", "left_semi"), "first-branches")
    paths = stage(below, "paths")
    while True:
        known = paths.unionByName(parents)
        up = known.select(F.col("conv").alias("above"), F.col("path").alias("_path"), F.col("above").alias("_above"))
        longer = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        paths = stage(paths.join(up, "above", "left").select("conv", longer.alias("path"), F.col("_above").alias("above")), "paths")
        if paths.where(F.col("above").isNotNull()).isEmpty():
            return paths.unionByName(first).select("conv", "path")


def format_chats(
    conversations: DataFrame,
    tokenizer: str,
    pattern: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Conversations as trees of turns: (turns, ends).

    Conversations that begin with the same turns share them: a tree holds all that begin
    with one turn, and each distinct beginning is one node. turns has a row per node, in
    depth-first order of `tree` and `start`: its tokens, from place `start` of the tree's
    sequence on; `branch`, the start of the stretch of nodes, each below the one before it,
    that it belongs to; `position` of the first token, the number of tokens before it in a
    conversation; `attends`, intervals (start, end) of the sequence with all tokens before
    it in a conversation, which its own tokens attend to besides those before them in the
    row; and which of its tokens are under the loss, loss_start to loss_end: the text of an
    assistant's turn. ends has a row per conversation: conv_id, tree, and the start of its
    last turn.

    Turns come by `turn`, then role and text; those without a turn number first. Null
    texts and roles are empty. Control strings in texts and roles are escaped. Rows
    without conv_id are one conversation. Repeated rows are turns of their own. An empty
    table gives no rows. Other columns are not looked at. The vocabulary file is read on
    the driver; texts are encoded in blocks, so that very long ones take no longer for
    their length. A conversation is a unit, as a document is: its digests are chained in
    one task.
    """
    coder = _coder(tokenizer, pattern)
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select(key.alias("conv"), F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    turns = stage(_chained(turns), "turns")
    # Of the conversations with the same beginning the smallest emits it, so what each one
    # emits are its turns from some place on: a branch.
    shared = turns.groupBy("prefix").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    shared = stage(shared, "shared-turns")
    hint = F.broadcast if shared.count() <= _BROADCAST_TURNS else (lambda df: df)
    own = turns.join(hint(shared), "prefix", "left").where(F.coalesce(F.col("first") == F.col("conv"), F.lit(True)))
    own = stage(_tokens(own, coder), "own-turns")

    # places of tokens within the branch
    narrow = own.select("conv", "place", "prefix", "up", F.size("tokens").cast("long").alias("n"))
    narrow = narrow.withColumn("end", F.sum("n").over(Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    narrow = stage(narrow, "places")
    branches = stage(narrow.groupBy("conv").agg(F.sum("n").alias("n"), F.min(F.struct("place", "up"))["up"].alias("up")), "branches")
    onto = narrow.select(F.col("prefix").alias("up"), F.col("conv").alias("parent"), F.col("place").alias("behind"), F.col("end").alias("tokens"))
    attached = stage(branches.where(F.col("up").isNotNull()).join(onto, "up").select("conv", "parent", "behind", "tokens"), "attached")
    # Depth first: a branch, then what leaves it, the latest first.
    paths = branches.join(_paths(branches, attached), "conv").select("conv", "n", "path")
    paths = paths.withColumn("tree", F.col("path")[0]["conv"]).withColumn("order", F.transform("path", lambda s: F.struct(s["later"], s["conv"])))
    placed = stage(totals_before(paths, ["order"], "n", "at").select("conv", "tree", "at", "path"), "placed")
    roots = placed.where(F.col("conv") == F.col("tree")).select("tree", F.col("at").alias("_root"))
    starts = stage(placed.join(roots, "tree").select("conv", "tree", (F.col("at") - F.col("_root")).alias("branch"), "path"), "starts")
    # The tokens that a branch continues: of each branch on its path what comes before it is left.
    steps = starts.where(F.size("path") > 1).select("conv", F.posexplode(F.slice("path", 2, F.size("path"))).alias("_k", "s"))
    above = starts.select(F.col("conv").alias("_parent"), F.col("branch").alias("_from"))
    steps = steps.join(above, F.col("s.parent") == F.col("_parent"))
    pieces = F.struct("_k", F.col("_from").alias("start"), (F.col("_from") + F.col("s.tokens")).alias("end"))
    before = steps.groupBy("conv").agg(F.array_sort(F.collect_list(pieces)).alias("pieces"))
    before = before.select("conv", F.transform("pieces", lambda p: F.struct(p["start"], p["end"])).alias("above"))
    none = F.array().cast("array<struct<start: long, end: long>>")
    starts = starts.drop("path").join(before, "conv", "left").withColumn("above", F.coalesce("above", none))
    continued = F.aggregate("above", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    starts = stage(starts.withColumn("continued", continued), "branch-starts")

    within = F.col("end") - F.col("n")
    start = F.col("branch") + within
    itself = F.when(within > 0, F.array(F.struct(F.col("branch").alias("start"), start.alias("end")))).otherwise(none)
    rows = narrow.select("conv", "place", "n", "end").join(starts, "conv")
    rows = rows.select(
        "conv", "place", "tree", start.alias("start"), "branch", (F.col("continued") + within).alias("position"), F.concat("above", itself).alias("attends")
    )
    rows = stage(rows.join(own, ["conv", "place"]).drop("conv", "place", "up"), "formatted")
    last = turns.groupBy("conv").agg(F.max(F.struct("place", "prefix", "conv_id")).alias("last"))
    ends = last.select(F.col("last.conv_id").alias("conv_id"), F.col("last.prefix").alias("prefix"))
    ends = ends.join(rows.select("prefix", "tree", "start"), "prefix").drop("prefix")
    return rows.drop("prefix"), ends


def read_chats(turns: DataFrame, ends: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Conversations as they stand in the result of `format_chats`: conv_id, turns (role,
    text), loss (all text under the loss, unescaped), formatted (the text with its marks).

    Every turn is decoded once; a conversation's are those in the intervals that its last
    turn attends to, and that turn itself, in order of position.
    """
    coder = _coder(tokenizer, pattern)

    def decode(batches):
        import pyarrow as pa

        encoder = coder()
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                columns = [rows.column(c) for c in ("tree", "start", "branch", "position")]
                tokens = rows.column("tokens").to_pylist()
                spans = zip(rows.column("loss_start").to_pylist(), rows.column("loss_end").to_pylist())
                columns += [pa.array(list(map(encoder.text, tokens)), pa.string())]
                columns += [pa.array([encoder.text(t[a:b]) for t, (a, b) in zip(tokens, spans)], pa.string())]
                yield pa.record_batch(columns, ["tree", "start", "branch", "position", "text", "loss"])

    texts = turns.select("tree", "start", "branch", "position", "tokens", "loss_start", "loss_end")
    texts = stage(texts.mapInArrow(decode, "tree string, start long, branch long, position long, text string, loss string"), "decoded")
    last = F.struct(F.col("branch").alias("start"), (F.col("start") + F.size("tokens")).alias("end"))
    seen = F.concat(F.filter("attends", lambda a: a["start"] != F.col("branch")), F.array(last))
    seen = ends.select(F.struct("conv_id").alias("conv"), "tree", "start").join(turns.select("tree", "start", seen.alias("seen")), ["tree", "start"])
    # every interval begins with a branch
    seen = seen.select("conv", "tree", F.explode("seen").alias("s")).select("conv", "tree", F.col("s.start").alias("branch"), F.col("s.end").alias("_to"))
    met = seen.join(texts, ["tree", "branch"]).where(F.col("start") < F.col("_to"))
    row = F.struct("position", "start", "text", unescape(F.col("loss")).alias("loss"))
    whole = met.groupBy("conv").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "")
    whole = whole.select("conv.conv_id", joined("loss").alias("loss"), joined("text").alias("formatted"))
    found = F.regexp_extract_all(F.substring("formatted", len(BEGIN) + 1, 2**31 - 1), F.lit(_TURN), F.lit(0))
    return whole.select("conv_id", F.transform(found, _turn).alias("turns"), "loss", "formatted")


def _turn(found: Column) -> Column:
    """Role and text of a turn with its marks."""

    def between(a: str, b: str) -> Column:
        return found.substr(F.lit(len(a) + 1), F.char_length(found) - len(a) - len(b))

    named = F.substring_index(between(OTHER[0], OTHER[2]), OTHER[1], 1)
    rest = found.substr(F.char_length(named) + len(OTHER[0] + OTHER[1]) + 1, F.char_length(found) - F.char_length(named) - len("".join(OTHER)))
    is_user, is_system, is_other = (found.startswith(c) for c in (USER[0], SYSTEM[0], OTHER[0]))
    role = F.when(is_user, "user").when(is_system, "system").when(is_other, unescape(named)).otherwise("assistant")
    text = F.when(is_user, between(*USER)).when(is_system, between(*SYSTEM)).when(is_other, rest).otherwise(between("", END))
    return F.struct(role.alias("role"), unescape(text).alias("text"))
