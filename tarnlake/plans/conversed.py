"""Queries over conversations, replays and runs taken up again, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.operators import compact as K
from tarnlake.operators import conversations as C
from tarnlake.operators import observations as O
from tarnlake.operators import replay as P
from tarnlake.operators import state as T
from tarnlake.operators import texts as X
from tarnlake.plans.analysis import ADVANCE, WINDOWS
from tarnlake.plans.behaviour import ORDER
from tarnlake.plans.bindings import EV, plays

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- messages, tokens, windows -----------------------------------------------------------------

RENDERED = """m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER w AS i, first_value(role) OVER w AS head, bool_and(role IN ('user', 'assistant')) FILTER (i0 > 0) OVER (PARTITION BY conv_id) AS fit, len(first_value(coalesce(text, '')) OVER w) AS len0, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i0 FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pc AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 12 + len(role) + 1 + len(text) + 11 WHEN i = 1 AND role = 'system' THEN len(text) WHEN role = 'user' THEN 8 + len(text) WHEN role = 'assistant' THEN 13 + len(text) ELSE len(text) END AS len_ FROM m),
st AS (SELECT conv_id, turn, conv_id % 2 = 0 OR (n > 1 AND head = 'system' AND coalesce(fit, true) AND len0 > 0) AS good, CAST(sum(len_) OVER (PARTITION BY conv_id ORDER BY turn) - len_ AS BIGINT) AS place, CAST(sum(len_) OVER (PARTITION BY conv_id) AS BIGINT) AS whole FROM pc)"""


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with even ids in the one form, the others in the other."""
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    other = F.when(first & (role == "system"), text).when(role == "user", F.concat(F.lit(C.OF_ROLE["user"]), text)).when(role == "assistant", F.concat(F.lit(C.OF_ROLE["assistant"]), text)).otherwise(text)
    piece = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(C.ANY_ROLE), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))).otherwise(other)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", piece.alias("piece"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "piece"))).alias("m"))
    return g.select("conv_id", F.array_join("m.piece", "").alias("text"), F.col("m.role").alias("roles"))


@query("marker_starts", f"WITH {RENDERED} SELECT conv_id, turn, place FROM st WHERE good")
def marker_starts(spark, d):
    s = C.marker_starts(rendered(spark, d), ["conv_id"], "text", "roles").where("error is null")
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    both = s.join(turns, "conv_id").select("conv_id", F.explode(F.arrays_zip("turns", "starts")).alias("x"))
    return both.select("conv_id", F.col("x.turns").alias("turn"), F.col("x.starts").alias("place"))


@query("target_windows", WINDOWS.replace(WINDOWS[WINDOWS.index("t AS (") : WINDOWS.index("l AS (")], RENDERED + ",\ns AS (SELECT conv_id, place // 4 AS pos, whole // 4 AS total FROM st WHERE good),\n"))
def target_windows(spark, d):
    """From rendered conversations (a token ends after every fourth character) to the window of each message's first token."""
    r = rendered(spark, d)
    s = C.marker_starts(r, ["conv_id"], "text", "roles").where("error is null").select("conv_id", F.posexplode("starts").alias("msg", "char_end"))
    whole = r.select("conv_id", F.length("text").alias("n"))
    tokens = whole.where("n >= 4").select("conv_id", F.explode(F.sequence(F.lit(4).cast("long"), F.col("n").cast("long"), F.lit(4).cast("long"))).alias("token_end"))
    at = O.message_tokens(tokens, s, ["conv_id"])
    starts = at.groupBy("conv_id").agg(F.array_sort(F.collect_list("tokens")).alias("starts")).join(whole, "conv_id").withColumn("total", F.expr("n div 4").cast("long"))
    w = starts.select("conv_id", "starts", F.posexplode(P.token_windows("total", "starts", F.lit(200).cast("long"), F.lit(100).cast("long"))).alias("w", "span"))
    wins = w.select("conv_id", F.col("w").cast("long").alias("w"), F.col("span")[0].alias("start"), F.col("span")[1].alias("end"))
    return P.assign_targets(at.select("conv_id", F.col("tokens").alias("pos")).distinct(), wins, ["conv_id"]).join(wins, ["conv_id", "w"])


# --- measured and generated --------------------------------------------------------------------

MEASURED = EV + """, fr AS (SELECT user_id, level, event_id, event_type, sec, row_number() OVER (PARTITION BY user_id ORDER BY level, ts, event_id) - 1 AS pos FROM ev),
sp AS (SELECT user_id, event_type, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS i FROM fr WHERE event_type IN ('click', 'purchase'))"""
DAMAGE = {1: "a frame differs", 2: "plays or their order changed", 3: "a step's identity or clock disagrees", 4: "an unknown play", 5: "a synthetic step"}


def recorded(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Users as recordings, levels as plays, events as frames, clicks and purchases as steps; the
    generated side of users whose id isn't a multiple of 6 is damaged, in a way each."""
    p = plays(spark, d)
    by = Window.partitionBy("user_id")
    f = p.withColumn("pos", F.row_number().over(by.orderBy("level", *ORDER)) - 1)
    g = f.groupBy("user_id", "level").agg(F.count("*").alias("state_count"), F.min("pos").alias("state_start"), F.max_by("outcome", "pos").alias("outcome"))
    g = g.withColumns({"ordinal": F.row_number().over(by.orderBy("level")) - 1, "play": F.concat(F.lit("p"), F.col("level").cast("string")), "run": F.lit(1), "document": F.col("level")})
    f = f.join(g.select("user_id", "level", "play", "state_start", "ordinal"), ["user_id", "level"]).withColumn("time", F.col("pos") - F.col("state_start"))
    way = F.pmod("user_id", F.lit(6))
    gen_plays = g.withColumn("outcome", F.when((way == 2) & (F.col("ordinal") == 0), "other").otherwise(F.col("outcome")))
    last = F.max("pos").over(by)
    gen_frames = f.withColumn("_last", last).where(~((way == 1) & (F.col("pos") == F.col("_last")))).select("user_id", "pos", "time", "level", F.lit(0).alias("attempt"))
    s = f.where("event_type in ('click', 'purchase')").withColumn("i", F.row_number().over(by.orderBy("pos")) - 1)
    hit = lambda k: (way == k) & (F.col("i") == 0)
    gen_steps = s.select(
        "user_id", "i", F.when(hit(5), "_advance").otherwise(F.col("event_type")).alias("action"), F.when(hit(4), "none").otherwise(F.col("play")).alias("play"), F.col("time").alias("frame"), F.lit(1).alias("run"),
        F.col("ordinal").alias("trial"), "level", F.lit(0).alias("attempt"), F.when(hit(3), F.col("sec") + 1).otherwise(F.col("sec")).alias("ts"), F.col("pos").alias("state_index"),
    )
    return g, f.select("user_id", "pos", "play", "time", F.col("sec").alias("ts")), gen_plays, gen_frames, gen_steps


@query("merged_conversations", f"WITH {MEASURED} SELECT user_id, i, event_type AS action, pos FROM sp WHERE user_id % 6 = 0")
def merged_conversations(spark, d):
    return C.merged_steps(*recorded(spark, d), ["user_id"])[0].select("user_id", F.col("i").cast("long").alias("i"), "action", F.col("pos").cast("long").alias("pos"))


@query("merge_errors", f"WITH {MEASURED} SELECT DISTINCT user_id, CASE user_id % 6 " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in DAMAGE.items()) + " END AS error FROM fr WHERE user_id % 6 IN (1, 2) OR (user_id % 6 > 2 AND user_id IN (SELECT user_id FROM sp))")
def merge_errors(spark, d):
    return C.merged_steps(*recorded(spark, d), ["user_id"])[1]


# --- types -------------------------------------------------------------------------------------

@query("known_interactions", """WITH t AS (SELECT 'c' || c_custkey AS name, 'n' || c_nationkey AS parent, true AS leaf, CASE WHEN c_custkey % 7 > 0 THEN upper(c_mktsegment) END AS colour FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, false, NULL FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', false, NULL FROM region),
l AS (SELECT c.colour, x.above FROM t c JOIN t n ON n.name = c.parent JOIN t r ON r.name = n.parent, LATERAL (SELECT unnest([c.name, n.name, r.name, 'world']) AS above) x WHERE c.leaf AND c.colour IS NOT NULL),
e AS (SELECT DISTINCT CAST(s_suppkey % 4 AS BIGINT) AS game, 'n' || s_nationkey AS actor, 'e' || (s_suppkey % 3) AS effect, CASE WHEN s_suppkey % 11 = 0 THEN 'EOS' WHEN s_suppkey % 5 = 0 THEN 'world' WHEN s_suppkey % 2 = 0 THEN 'c' || s_suppkey ELSE 'r' || (s_nationkey % 5) END AS actee FROM supplier)
SELECT DISTINCT game, a.colour AS actor, effect, b.colour AS actee FROM e JOIN l a ON a.above = e.actor JOIN l b ON b.above = e.actee WHERE e.actee <> 'EOS'""")
def known_interactions(spark, d):
    c, n, r, s = (table(spark, d, t) for t in ("customer", "nation", "region", "supplier"))
    text = lambda head, col: F.concat(F.lit(head), F.col(col).cast("string"))
    none = F.lit(None).cast("string").alias("colour")
    types = c.select(text("c", "c_custkey").alias("name"), text("n", "c_nationkey").alias("parent"), F.lit(True).alias("leaf"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("colour"))
    types = types.unionByName(n.select(text("n", "n_nationkey").alias("name"), text("r", "n_regionkey").alias("parent"), F.lit(False).alias("leaf"), none)).unionByName(r.select(text("r", "r_regionkey").alias("name"), F.lit("world").alias("parent"), F.lit(False).alias("leaf"), none))
    types = types.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("game"), "*")
    k = F.col("s_suppkey")
    actee = F.when(k % 11 == 0, "EOS").when(k % 5 == 0, "world").when(k % 2 == 0, text("c", "s_suppkey")).otherwise(F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")))
    effects = s.select((k % 4).cast("long").alias("game"), text("n", "s_nationkey").alias("actor"), F.concat(F.lit("e"), (k % 3).cast("string")).alias("effect"), actee.alias("actee"))
    return C.known_interactions(types, effects, ["game"])


@query("avatar_deaths", f"WITH {EV} SELECT event_id, event_type = 'error' AND k % 2 = 0 AS died FROM ev")
def avatar_deaths(spark, d):
    """A game's text per event, and an event of it that kills a type which the text names."""
    text = F.concat(F.lit("SpriteSet\n  wall > Immovable\n\t"), F.col("event_type"), F.lit(" > MovingAvatar img=a\n  x > Missile Avatar\n"), F.when(F.col("k") % 2 == 0, "  error>ShootAvatar").otherwise("  error > Passive"))
    event = F.array(F.array(F.lit("stepBack"), F.lit("error")), F.array(F.when(F.col("event_type") == "error", "killSprite").otherwise("bounce"), F.lit("error"), F.lit("wall")))
    # an odd k names the type of the event itself, so that only what the text says of `error` counts
    p = plays(spark, d).withColumn("event_type", F.col("event_type"))
    own = F.array_except(C.avatar_classes(text), F.when(F.col("k") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type")))
    return p.select("event_id", C.died(event, own).alias("died"))


@query("known_from_texts", f"""WITH {EV}, t AS (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'purchase' THEN 'BLUE' ELSE upper(event_type) END AS c, CASE WHEN event_type IN ('click', 'purchase') THEN 'moving' ELSE 'static' END AS g FROM ev)
SELECT DISTINCT a.user_id, a.c AS actor, 'kill' AS effect, b.c AS actee FROM t a JOIN t b USING (user_id) WHERE a.g = 'moving' AND b.g = 'static'
UNION SELECT DISTINCT a.user_id, a.c, 'push', b.c FROM t a JOIN t b USING (user_id) WHERE a.event_type = 'error' AND (b.event_type = 'click' OR b.g = 'moving')""")
def known_from_texts(spark, d):
    """A game's text for each user, with the user's event types as its sprites: types, effects and what meets what."""
    p = plays(spark, d).select("user_id", "event_type").distinct()
    line = F.when(F.col("event_type") == "purchase", "      purchase >").otherwise(F.concat(F.lit("      "), F.col("event_type"), F.lit(" > Missile img=colors/"), F.col("event_type")))
    moving = F.col("event_type").isin("click", "purchase")
    g = p.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(moving, line))), "\n").alias("m"), F.array_join(F.array_sort(F.collect_list(F.when(~moving, line))), "\n").alias("s"))
    text = F.concat_ws("\n", F.lit("BasicGame # comment\n  SpriteSet\n    moving > Mover img=colors/blue"), "m", F.lit("    static > img=colors/none"), "s", F.lit("  TerminationSet\n    Timeout limit=9\n  InteractionSet\n    moving static > kill\n    click EOS > stepBack\n    error click moving > push score=1"))
    s = C.section_rows(g.select("user_id", X.outline(text).alias("o")), ["user_id"], "o")
    return C.known_interactions(C.game_types(s, ["user_id"]), C.game_effects(s, ["user_id"]), ["user_id"])


# --- compact replays, resumed runs -------------------------------------------------------------

@query("compacted", f"""WITH {EV}, f AS (SELECT user_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM ev),
b AS (SELECT *, lag(event_type) OVER w AS pt, lag(k) OVER w AS pk FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
j AS (SELECT user_id, k,
  length('{{"frame":' || frame || ',"sprites":{{"' || event_type || '":[{{"col":' || (k / 2.0)::DOUBLE || ',"id":' || k || ',"uid":"' || k || '"}}],"total":[{{"col":1.0,"id":' || k // 10 || ',"uid":"' || k || '"}}]}}}}') + 1 AS before,
  length('{{"frame":' || frame || ',"sprites":{{' || array_to_string(list_filter([
    CASE WHEN pt IS DISTINCT FROM event_type OR pk <> k THEN '"' || event_type || '":[{{"col":' || (k / 2.0)::DOUBLE || ',"id":' || k || '}}]' END,
    CASE WHEN pk IS NULL OR pk // 10 <> k // 10 THEN '"total":[{{"col":1.0,"id":' || k // 10 || '}}]' END, CASE WHEN pt <> event_type THEN '"' || pt || '":null' END], lambda x: x IS NOT NULL), ',') || '}}}}') + 1 AS after FROM b)
SELECT user_id, CAST(count(*) AS BIGINT) AS frames, CAST(2 * count(*) AS BIGINT) AS sprites, CAST(count(*) FILTER (k % 2 = 1) AS BIGINT) AS fractional, true AS same, CAST(sum(before) AS BIGINT) AS bytes_before, CAST(sum(after) AS BIGINT) AS bytes_after FROM j GROUP BY 1""")
def compacted(spark, d):
    sprite = lambda col, n: F.array(F.struct(col.cast("double").alias("col"), n.alias("id"), F.col("k").cast("string").alias("uid")))
    p = plays(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)
    frames = p.select("user_id", "frame", F.create_map(F.col("event_type"), sprite(F.col("k") / 2, F.col("k")), F.lit("total"), sprite(F.lit(1.0), F.expr("k div 10"))).alias("sprites"))
    small = K.compacted(frames, ["user_id"], "frame", [], ["uid"])
    proof = K.verified(small, K.evidence(frames, ["user_id"], "frame", [], ["uid"]), ["user_id"], "frame", [])
    sizes = K.stored_bytes(frames, ["user_id"], "bytes_before").join(K.stored_bytes(small, ["user_id"], "bytes_after"), "user_id")
    return proof.drop("digest").join(sizes, "user_id")


@query("resumed_runs", ADVANCE)
def resumed_runs(spark, d):
    """Each user's run stopped after its first half, and carried on from the counters."""
    w = Window.partitionBy("user_id")
    p = plays(spark, d).withColumns({"_i": F.row_number().over(w.orderBy(*ORDER)), "_n": F.count("*").over(w)})
    half = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("_i", "outcome"))))["outcome"]
    r = p.groupBy("user_id").agg(half(F.col("_i") * 2 <= F.col("_n")).alias("early"), half(F.col("_i") * 2 > F.col("_n")).alias("late"))
    r = r.withColumn("first", T.counters(F.col("early"), 2, 3, 12))
    return r.withColumn("s", T.counters(F.col("late"), 2, 3, 12, F.col("first"))).select("user_id", "s.level", "s.attempts", "s.reason")


@query("restored_runs", f"""WITH {EV}, s AS (SELECT *, event_type = 'view' AND k % 10 = 0 AS up, k % 13 = 0 AS crashed FROM ev),
l AS (SELECT user_id, arg_max(outcome, (ts, event_id)) FILTER (NOT up AND NOT crashed) AS o, arg_max(level, (ts, event_id)) FILTER (up) AS l FROM s GROUP BY 1)
SELECT user_id, CAST(coalesce(max(l) + 1, 0) AS INTEGER) AS resume_level, CAST(count(*) FILTER (NOT up AND NOT crashed) AS BIGINT) AS step_num, CAST(3 * count(*) FILTER (NOT up AND NOT crashed) AS BIGINT) AS total_frames, CAST(sum(k) AS BIGINT) AS k, CAST(sum(steps) AS BIGINT) AS retries,
  CAST(count(*) FILTER (NOT up AND NOT crashed AND outcome = 'win') AS BIGINT) AS wins, CAST(count(*) FILTER (NOT up AND NOT crashed AND outcome = 'loss') AS BIGINT) AS losses,
  CAST(count(*) FILTER (NOT up AND NOT crashed AND outcome = 'win') - count(*) FILTER (NOT up AND NOT crashed AND outcome = 'loss') AS BIGINT) AS success, CASE max(o) WHEN 'win' THEN 'won' WHEN 'loss' THEN 'died' ELSE '' END AS prev_outcome
FROM s JOIN l USING (user_id) GROUP BY 1""")
def restored_runs(spark, d):
    p = plays(spark, d)
    steps = p.select(
        "user_id", *ORDER, F.when((F.col("event_type") == "view") & (F.col("k") % 10 == 0), "_level_advance").otherwise("UP").alias("action"), "level", (F.col("outcome") == "win").alias("won"), (F.col("outcome") == "loss").alias("lose"),
        (F.col("k") % 13 == 0).alias("crashed"), F.col("steps").alias("retries"), "k",
    )
    return T.restored(steps, ["user_id"], ORDER, ["k"], 2)
