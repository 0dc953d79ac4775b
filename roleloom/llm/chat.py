"""Chat formatting into windows of a token budget, in DataFrame operations alone.

Prefix sums of turn lengths decide which window a turn belongs to, so no turn is
looked at in a loop.  Windows are aligned to turns; each begins with the
conversation's system turn and a limited history, both repeated and masked; every
assistant text is a training target in exactly one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Control strings of the template; no escaped text contains "<" or "[".
OPEN, AGAIN, CLOSE, END = "<|turn:", "<|again:", "|>\n", "<|end|>\n"
BUDGET = 2048
HISTORY = 256
#: Turns of a conversation whose lengths one task sums.
CHUNK = 1024

c, lit = F.col, F.lit


def escape(text: Column) -> Column:
    """Reversible: afterwards the text holds neither "<" nor "["."""
    return F.replace(F.replace(F.replace(text, lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit("["), lit("&lbr;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, lit("&lbr;"), lit("[")), lit("&lt;"), lit("<")), lit("&amp;"), lit("&"))


def default_tokens(segment: Column) -> Column:
    """A length in tokens that needs no tokenizer: four UTF-8 bytes each."""
    return F.ceil(F.octet_length(segment) / 4)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=default_tokens) -> DataFrame:
    """(conv_id, window, formatted, loss, n_tokens): ``loss`` lists the code-point spans (start from 0, length) that are trained on.

    A conversation's first turn is its system turn if its role says so.  The other turns fill windows of ``budget`` tokens, less the
    system turn and ``history``; a turn that alone is longer, or crosses a window's edge, has a window of its own and is never cut.
    Turns are ordered by turn, role and text (nulls first); repeated rows are turns of their own; null texts and roles are empty; a null conv_id is a
    conversation like others; empty tables give no rows; other columns are ignored.
    """
    t = conversations.select("conv_id", "turn", F.coalesce("role", lit("")).alias("role"), F.coalesce("text", lit("")).alias("text")).withColumn("chunk", F.floor(F.coalesce(c("turn"), lit(0)) / CHUNK))
    t = t.withColumn("esc", escape(c("text"))).withColumn("head", F.concat(escape(c("role")), lit(CLOSE)))
    t = t.withColumn("n_tok", tokens(F.concat(lit(OPEN), "head", "esc", lit(END))).cast("long"))
    # Prefix sums in two steps: over the chunks of a conversation, then inside each chunk, so that no task sorts a whole long conversation.
    inside = W.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text")
    chunks = t.groupBy("conv_id", "chunk").agg(F.sum("n_tok").alias("tok"), F.count("*").alias("rows"), F.min(F.struct(F.coalesce(c("turn"), lit(-(1 << 62))).alias("o"), "role", "text", "head", "esc", "n_tok")).alias("first"))
    along = W.partitionBy("conv_id").orderBy("chunk")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    chunks = (chunks.withColumn("tok0", F.coalesce(F.sum("tok").over(before), lit(0))).withColumn("row0", F.coalesce(F.sum("rows").over(before), lit(0)))
              .withColumn("lead", F.first("first").over(along)).select("conv_id", "chunk", "tok0", "row0", F.when(c("lead.role") == "system", c("lead")).alias("sys")))
    same = lambda a, b, *names: [F.equal_null(a[n], b[n]) for n in names]
    t = (t.withColumn("in_row", F.row_number().over(inside)).withColumn("in_tok", F.sum("n_tok").over(inside.rowsBetween(W.unboundedPreceding, 0))).alias("t")
         .join(chunks.withColumnRenamed("conv_id", "conv2").withColumnRenamed("chunk", "chunk2"), F.equal_null("conv_id", "conv2") & F.equal_null("chunk", "chunk2"))
         .drop("conv2", "chunk2"))
    t = t.withColumn("row", c("row0") + c("in_row")).withColumn("sys_tok", F.coalesce(c("sys.n_tok"), lit(0)))
    t = t.withColumn("is_sys", (c("row") == 1) & c("sys").isNotNull()).withColumn("stop", c("tok0") + c("in_tok") - c("sys_tok")).withColumn("start", c("stop") - c("n_tok"))
    stride = F.greatest(lit(budget) - c("sys_tok") - history, lit(1))
    t = t.withColumn("slot", F.floor(F.greatest(c("start"), lit(0)) / stride)).withColumn("cross", (F.floor((c("stop") - 1) / stride) > c("slot")).cast("int"))
    # A conversation that has nothing but its system turn still gives a window.
    t = t.withColumn("slot", F.when(c("is_sys"), 0).otherwise(c("slot"))).withColumn("cross", F.when(c("is_sys"), 0).otherwise(c("cross")))
    t = t.withColumn("window", c("slot") * 2 + c("cross"))
    own = t.where(~c("is_sys")).select("conv_id", "window", lit(2).alias("part"), "row", "role", "head", "esc", "start", "n_tok")
    starts = own.groupBy("conv_id", "window").agg(F.min("start").alias("w_start"))
    buckets = F.sequence(F.floor((c("start") + c("n_tok")) / budget), F.floor((c("start") + history) / budget))
    earlier = (own.where(c("n_tok") <= history).withColumn("b", F.explode(buckets)).alias("o")
               .join(starts.withColumn("b", F.floor(c("w_start") / budget)).alias("w"), F.equal_null("o.conv_id", "w.conv_id") & (c("o.b") == c("w.b")))
               .where((c("w_start") >= c("start") + c("n_tok")) & (c("start") >= c("w_start") - history))
               .select("o.conv_id", c("w.window").alias("window"), lit(1).alias("part"), "row", "role", "head", "esc", "start", "n_tok"))
    lead = t.where("is_sys").select(c("conv_id").alias("c2"), c("head").alias("s_head"), c("esc").alias("s_esc"), c("n_tok").alias("s_tok"))
    system = (starts.join(lead, F.equal_null("conv_id", "c2")).select("conv_id", "window", lit(0).alias("part"), lit(1).cast("long").alias("row"), lit("system").alias("role"), c("s_head").alias("head"), c("s_esc").alias("esc"), lit(0).cast("long").alias("start"), c("s_tok").alias("n_tok")))
    alone = t.where("is_sys").join(starts.select(c("conv_id").alias("c2")).distinct(), F.equal_null("conv_id", "c2"), "left_anti").select("conv_id", lit(0).cast("long").alias("window"), lit(0).alias("part"), "row", "role", "head", "esc", "start", "n_tok")
    every = system.unionByName(alone).unionByName(earlier).unionByName(own)
    first_window = F.min("window").over(W.partitionBy("conv_id"))
    every = every.withColumn("is_new", (c("part") == 2) | ((c("part") == 0) & (c("window") == first_window)))
    every = every.withColumn("segment", F.concat(F.when(c("is_new"), OPEN).otherwise(AGAIN), "head", "esc", lit(END)))
    at = F.coalesce(F.sum(F.length("segment")).over(W.partitionBy("conv_id", "window").orderBy("part", "row").rowsBetween(W.unboundedPreceding, -1)), lit(0))
    every = every.withColumn("at", at + F.length(F.when(c("is_new"), OPEN).otherwise(AGAIN)) + F.length("head"))
    target = (c("role") == "assistant") & (c("part") == 2)
    rows = every.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("part", "row", "segment"))).alias("s"), F.sum("n_tok").alias("n_tokens"),
                                                  F.sort_array(F.collect_list(F.when(target, F.struct(c("at").alias("start"), F.length("esc").cast("long").alias("length"))))).alias("loss"))
    return rows.select("conv_id", "window", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"), "loss", "n_tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, targets, formatted_chars) from formatted windows alone: the turns (role, text) and the texts under the loss mask, unescaped, in order."""
    segments = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda s: s.startswith(OPEN))
    head = F.length(lit(OPEN))
    turns = F.transform(segments, lambda s: F.struct(unescape(F.substr(s, head + 1, F.instr(s, CLOSE) - head - 1)).alias("role"), unescape(F.substr(s, F.instr(s, CLOSE) + len(CLOSE))).alias("text")))
    masked = F.array_join(F.transform("loss", lambda m: unescape(F.substr(c("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    per = windows.select("conv_id", "window", turns.alias("turns"), masked.alias("masked"), F.length("formatted").alias("n"))
    done = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "masked"))).alias("w"), F.sum("n").alias("formatted_chars"))
    return done.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["masked"]), "").alias("targets"), "formatted_chars")
