"""Scalar functions over texts, actions and poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import control, geometry, text
from episodica.operators import ledger
from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources import files
from episodica.sources.tables import frames, table

_COLOURS = ("red", "blue", "green", "black", "white", "yellow")


def _third(word: str) -> str:
    """SQL for the third person of a verb."""
    return f"(CASE WHEN regexp_matches({word}, '(s|x|z|ch|sh|o)$') THEN {word} || 'es' WHEN regexp_matches({word}, '[^aeiou]y$') THEN regexp_replace({word}, 'y$', 'ies') ELSE {word} || 's' END)"


def _clause(source: str) -> str:
    """SQL for an action clause."""
    words = f"string_split(regexp_replace(regexp_replace(rtrim(trim({source}), '.'), '\\s+', ' ', 'g'), '^((?:{'|'.join(text.LEADING)})[ ,]+)+', '', 'i'), ' ')"
    known = ", ".join(f"'{v}'" for v in text.KNOWN_VERBS)
    follows = f"(lower({words}[i - 1]) IN ('and', 'then') OR {words}[i - 1] LIKE '%,') AND lower(w) IN ({known})"
    return f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = 1 OR ({follows}) THEN {_third('lower(w)')} ELSE w END), ' ')"


def _qmul(p: str, q: str) -> str:
    """SQL for a product of quaternions (w, x, y, z)."""
    (w, x, y, z), (a, b, c, d) = ([f"{n}[{i}]" for i in range(1, 5)] for n in (p, q))
    return f"[{w}*{a}-{x}*{b}-{y}*{c}-{z}*{d}, {w}*{b}+{x}*{a}+{y}*{d}-{z}*{c}, {w}*{c}-{x}*{d}+{y}*{a}+{z}*{b}, {w}*{d}+{x}*{c}-{y}*{b}+{z}*{a}]"


def _qinv(q: str) -> str:
    return f"[{q}[1], -{q}[2], -{q}[3], -{q}[4]]"


def _unit(first: int) -> str:
    e = [f"embedding[{first + i}]::DOUBLE" for i in range(4)]
    n = "sqrt(" + " + ".join(f"{x} * {x}" for x in e) + ")"
    return "[" + ", ".join(f"{x} / {n}" for x in e) + "]"


def _quaternions(df, **places: int):
    """Unit quaternions from places of the embedding; each step is a column of its own, as its parts are used many times."""
    raw = df.withColumns({f"_{n}": F.transform(F.slice("embedding", at, 4), lambda v: v.cast("double")) for n, at in places.items()})
    return raw.withColumns({n: geometry.quat_unit(F.col(f"_{n}")) for n in places}).drop(*[f"_{n}" for n in places])


@query(f"""SELECT p_partkey, array_to_string([w FOR w IN string_split(lower(p_name), ' ') IF w NOT IN {_COLOURS}], ' ') AS plain,
       lower(p_type) || '|' || array_to_string(list_sort([w FOR w IN string_split(lower(p_name), ' ') IF w NOT IN {_COLOURS}]), ' ') || '|' || lower(p_brand) AS signature FROM part""")
def semantic_signature(spark, sf_dir):
    """Words without colours, and the signature by which two tasks mean the same."""
    words = text.without_words(F.split(F.lower("p_name"), " "), _COLOURS)
    signature = F.concat_ws("|", F.lower("p_type"), F.array_join(F.array_sort(words), " "), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("plain"), signature.alias("signature"))


_ASKED = "['Please pick', 'Now, carry', 'Then wash', 'Push', 'First go to'][p_partkey % 5 + 1] || ' the  ' || p_name || ', turn it and lay it on the mat.'"


@query(f"""WITH a AS (SELECT p_partkey, {_ASKED} AS asked FROM part) SELECT p_partkey, {_clause('asked')} AS clause FROM a""")
def action_clauses(spark, sf_dir):
    """Instructions as clauses in the third person."""
    verbs = F.array(*[F.lit(v) for v in ("Please pick", "Now, carry", "Then wash", "Push", "First go to")])
    asked = F.concat(F.element_at(verbs, (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" the  "), F.col("p_name"), F.lit(", turn it and lay it on the mat."))
    return table(spark, sf_dir, "part").select("p_partkey", text.action_clause(asked, control.verb_form).alias("clause"))


@query(f"""WITH a AS (SELECT n_regionkey, list({_clause("'Move the ' || n_name || '.'")} ORDER BY n_nationkey) AS c FROM nation WHERE n_nationkey > 0 GROUP BY 1)
SELECT n_regionkey, CASE WHEN len(c) = 1 THEN c[1] ELSE 'first ' || array_to_string(c, ', then ') || '; in exactly this order' END AS action FROM a""")
def action_sentence(spark, sf_dir):
    """The actions of each episode in one sentence, in order."""
    n = table(spark, sf_dir, "nation").where("n_nationkey > 0")
    clause = text.action_clause(F.concat(F.lit("Move the "), F.col("n_name"), F.lit(".")), control.verb_form)
    c = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", clause.alias("c")))).alias("c"))
    return c.select("n_regionkey", text.ordered_actions(F.transform("c", lambda x: x["c"])).alias("action"))


@query("""SELECT p_partkey, printf('A hand reaches in empty from the %s edge and takes the %s. By %.2f seconds the task is complete; the clip ends at %.2f seconds.', ['bottom', 'top', 'left', 'right'][p_partkey % 4 + 1], p_name, p_size / 4.0 - 0.25, p_size / 4.0) AS prompt FROM part""")
def prompt_template(spark, sf_dir):
    edge = F.element_at(F.array(*[F.lit(e) for e in ("bottom", "top", "left", "right")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    end = F.col("p_size") / F.lit(4.0)
    prompt = F.format_string("A hand reaches in empty from the %s edge and takes the %s. By %.2f seconds the task is complete; the clip ends at %.2f seconds.", edge, F.col("p_name"), end - 0.25, end)
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))


@query(f"""WITH {FRAMES_SQL} SELECT event_id, printf('user_%03d/%s#frame=%d', user_id, event_type, frame_index) AS evidence,
       'the page ' || CASE event_type WHEN 'view' THEN 'is seen by' WHEN 'click' THEN 'is pressed by' ELSE replace('is_used_by', '_', ' ') END || ' user ' || user_id AS sentence,
       printf('episode_%06d', user_id) AS episode FROM frames""")
def evidence_reference(spark, sf_dir):
    """A frame as a reference, its relation as a sentence, its episode as a padded id."""
    relation = F.when(F.col("event_type") == "view", "is seen by").when(F.col("event_type") == "click", "is pressed by").otherwise(F.replace(F.lit("is_used_by"), F.lit("_"), F.lit(" ")))
    return frames(spark, sf_dir).select(
        "event_id", F.format_string("user_%03d/%s#frame=%d", "user_id", "event_type", "frame_index").alias("evidence"),
        F.concat(F.lit("the page "), relation, F.lit(" user "), F.col("user_id").cast("string")).alias("sentence"), F.format_string("episode_%06d", "user_id").alias("episode"),
    )


@query("""SELECT doc_id, left(text, 500) AS head, CASE WHEN length(text) <= 160 THEN text ELSE regexp_replace(left(text, 160), '\\s+\\S*\\z', '') END AS brief FROM documents""")
def text_cuts(spark, sf_dir):
    """The first 500 signs, and at most 160 without a broken word."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(500)).alias("head"), text.cut_at_word(F.col("text"), 160).alias("brief"))


@query("""SELECT p_partkey, replace(replace(replace(replace('<b>' || p_name || '</b> & "' || p_brand || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, (p_size % 4) || ' clip' || CASE WHEN p_size % 4 = 1 THEN '' ELSE 's' END AS badge FROM part""")
def badge_labels(spark, sf_dir):
    raw = F.concat(F.lit("<b>"), F.col("p_name"), F.lit('</b> & "'), F.col("p_brand"), F.lit('"'))
    return table(spark, sf_dir, "part").select("p_partkey", text.html_escaped(raw).alias("escaped"), text.counted(F.col("p_size") % 4, "clip").alias("badge"))


@query("""SELECT event_id, event_type || ' ' || user_id AS plain, props AS reply FROM events""")
def stripped_replies(spark, sf_dir):
    """Terminal colours and code fences removed."""
    esc = F.lit("\x1b[")
    coloured = F.concat(esc, F.lit("31;1m"), F.col("event_type"), esc, F.lit("0m "), esc, F.lit("2K"), F.col("user_id").cast("string"))
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n"))
    return table(spark, sf_dir, "events").select("event_id", text.without_colour_codes(coloured).alias("plain"), text.without_fence(fenced).alias("reply"))


_A, _I, _C = ("(embedding[%s]::DOUBLE)" % k for k in ("i", "i + 8", "i + 16"))
_DESIRED = f"least(greatest({_I} + {_A}, -0.2), 0.2)"
_LIMITED = f"least(greatest({_DESIRED}, {_C} - 0.12), {_C} + 0.12)"


@query(f"""WITH d AS (SELECT vec_id, [{_LIMITED} FOR i IN range(1, 6)] AS joints, len([i FOR i IN range(1, 6) IF abs({_DESIRED} - ({_I} + {_A})) > 1e-9]) > 0 AS arm_range, len([i FOR i IN range(1, 6) IF abs({_DESIRED} - {_LIMITED}) > 1e-9]) > 0 AS arm_rate,
    embedding[6]::DOUBLE * 300 AS g, least(greatest(embedding[6]::DOUBLE * 300, 0), 100) AS grip, embedding[22]::DOUBLE AS now FROM embeddings),
g AS (SELECT *, -0.1 + grip / 100 * 1.8 AS wanted FROM d), r AS (SELECT *, least(greatest(wanted, now - 0.12), now + 0.12) AS got FROM g)
SELECT vec_id, round(list_sum(joints), 6) AS joint_sum, arm_range, arm_rate, abs(grip - g) > 1e-9 AS grip_range, abs(got - wanted) > 1e-9 AS grip_rate, round(least(greatest(got, -0.1), 1.7), 6) AS grip FROM r""")
def action_decode(spark, sf_dir):
    """Actions relative to a start, held within ranges and rates, with what was clipped."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings")
    asked = [at(i + 8) + at(i) for i in range(1, 6)]
    desired = [geometry.clip(x, F.lit(-0.2), F.lit(0.2)) for x in asked]
    limited = [geometry.clip(x, at(i + 16) - 0.12, at(i + 16) + 0.12) for i, x in enumerate(desired, 1)]
    any_off = lambda xs, ys: F.exists(F.array(*[F.abs(x - y) > 1e-9 for x, y in zip(xs, ys, strict=True)]), lambda v: v)
    raw, now = at(6) * 300, at(22)
    grip = geometry.clip(raw, F.lit(0.0), F.lit(100.0))
    wanted = -0.1 + grip / 100 * 1.8
    got = geometry.clip(wanted, now - 0.12, now + 0.12)
    return e.select(
        "vec_id", F.round(sum(limited[1:], limited[0]), 6).alias("joint_sum"), any_off(desired, asked).alias("arm_range"), any_off(desired, limited).alias("arm_rate"),
        (F.abs(grip - raw) > 1e-9).alias("grip_range"), (F.abs(got - wanted) > 1e-9).alias("grip_rate"), F.round(geometry.clip(got, F.lit(-0.1), F.lit(1.7)), 6).alias("grip"),
    )


#: The tool's axes in those of the wrist: a third of a turn about the diagonal, as a unit quaternion.
_BASIS = (0.5, 0.5, 0.5, 0.5)
_LEVER = 0.12


@query(f"""WITH p AS (SELECT vec_id, {_unit(1)} AS r0, {_unit(5)} AS rt, [0.5, 0.5, 0.5, 0.5] AS b, [0.0, 0.0, 0.0, {_LEVER}] AS lever FROM embeddings),
i AS (SELECT *, {_qinv('r0')} AS r0i, {_qinv('rt')} AS rti, {_qinv('b')} AS bi FROM p),
d AS (SELECT *, {_qmul('r0i', 'rt')} AS d0, {_qmul('rt', 'lever')} AS lt, {_qmul('r0', 'lever')} AS l0 FROM i),
e AS (SELECT *, {_qmul('bi', 'd0')} AS e0, {_qmul('lt', 'rti')} AS vt, {_qmul('l0', 'r0i')} AS v0 FROM d),
f AS (SELECT *, {_qmul('e0', 'b')} AS q FROM e)
SELECT vec_id, round(q[1] * sign(q[1]), 6) AS w, round(q[2] * sign(q[1]), 6) AS x, round(q[3] * sign(q[1]), 6) AS y, round(q[4] * sign(q[1]), 6) AS z,
       round(v0[2] - vt[2], 6) AS dx, round(v0[3] - vt[3], 6) AS dy, round(v0[4] - vt[4], 6) AS dz FROM f""")
def frame_transform(spark, sf_dir):
    """A measured turn of the tool in the frame of a virtual wrist, and the lever's part of its way."""
    basis = F.array(*[F.lit(x) for x in _BASIS])
    p = _quaternions(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), r0=1, rt=5)
    p = p.withColumns({"b": basis, "bi": geometry.quat_inv(basis), "lever": F.array(F.lit(0.0), F.lit(0.0), F.lit(_LEVER)), "r0i": geometry.quat_inv(F.col("r0"))})
    p = p.withColumn("d", geometry.quat_mul(F.col("r0i"), F.col("rt"))).withColumn("e", geometry.quat_mul(F.col("bi"), F.col("d"))).withColumn("t", geometry.quat_mul(F.col("e"), F.col("b")))
    moved = p.select("vec_id", geometry.quat_canonical(F.col("t")).alias("q"), geometry.rotate(F.col("r0"), F.col("lever")).alias("v0"), geometry.rotate(F.col("rt"), F.col("lever")).alias("vt"))
    return moved.select("vec_id", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate("wxyz")], *[F.round(F.col("v0")[i] - F.col("vt")[i], 6).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


@query(f"""WITH p AS (SELECT vec_id, {_unit(1)} AS a, {_unit(5)} AS b, embedding FROM embeddings), i AS (SELECT *, {_qinv('a')} AS ai FROM p), d AS (SELECT *, {_qmul('ai', 'b')} AS q FROM i)
SELECT vec_id, round(abs(q[1]), 6) AS w, round(q[2] * sign(q[1]), 6) AS x, round(embedding[10]::DOUBLE - embedding[9]::DOUBLE, 6) AS "step" FROM d""")
def relative_action(spark, sf_dir):
    """The way and the turn from a start pose, with a real part that is not negative."""
    p = _quaternions(table(spark, sf_dir, "embeddings"), a=1, b=5).withColumn("t", geometry.quat_mul(geometry.quat_inv(F.col("a")), F.col("b")))
    d = p.select("vec_id", geometry.quat_canonical(F.col("t")).alias("q"), (F.element_at("embedding", 10).cast("double") - F.element_at("embedding", 9).cast("double")).alias("step"))
    return d.select("vec_id", F.round(F.col("q")[0], 6).alias("w"), F.round(F.col("q")[1], 6).alias("x"), F.round("step", 6).alias("step"))


@query("""SELECT vec_id, list_sum(list_transform(c, lambda x, i: x * i)) AS weighed, len(c) AS channels FROM (SELECT vec_id, [round(CASE WHEN i BETWEEN 14 AND 18 THEN embedding[i - 13]::DOUBLE WHEN i = 28 THEN embedding[6]::DOUBLE ELSE 0 END, 3) FOR i IN range(0, 30)] AS c FROM embeddings)""")
def channel_scatter(spark, sf_dir):
    """Joints and gripper at their places among thirty channels."""
    values = F.transform(F.slice("embedding", 1, 6), lambda v: F.round(v.cast("double"), 3))
    c = table(spark, sf_dir, "embeddings").select("vec_id", geometry.scatter(values, [14, 15, 16, 17, 18, 28], 30).alias("c"))
    weighed = F.aggregate(F.transform("c", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return c.select("vec_id", weighed.alias("weighed"), F.size("c").cast("long").alias("channels"))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice / 200000 - 0.2 AS t FROM orders), u AS (SELECT o_orderkey, least(greatest(t, 0), 1) AS u FROM t) SELECT o_orderkey, round(10 * power(u, 3) - 15 * power(u, 4) + 6 * power(u, 5), 6) AS place FROM u""")
def min_jerk_profile(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(geometry.min_jerk(F.col("o_totalprice") / 200000 - 0.2), 6).alias("place"))


@query("""SELECT l_orderkey, count(*) AS n, round(sum((l_tax - 0.0) / (0.08 - 0.0) * 100), 4) AS percent, round(sum(greatest(l_quantity / 4, l_discount * 100) * 0.12), 4) AS cost FROM lineitem GROUP BY 1""")
def gripper_and_cost(spark, sf_dir):
    """Opening in percent of its range; the greater of the seconds asked for and delivered, at a price."""
    percent = (F.col("l_tax") - 0.0) / (0.08 - 0.0) * 100
    cost = F.greatest(F.col("l_quantity") / 4, F.col("l_discount") * 100) * 0.12
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(percent), 4).alias("percent"), F.round(F.sum(cost), 4).alias("cost"))


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT user_id, value, lag(value, 3) OVER (PARTITION BY user_id ORDER BY frame_index) AS held FROM frames)
SELECT user_id, round(avg(abs(value - held)), 6) AS mae, count(held) AS n FROM p GROUP BY 1""")
def persistence_baseline(spark, sf_dir):
    """The error of repeating the last value three steps on."""
    p = frames(spark, sf_dir).withColumn("held", F.lag("value", 3).over(seq.by(["user_id"])))
    return p.groupBy("user_id").agg(F.round(F.avg(F.abs(F.col("value") - F.col("held"))), 6).alias("mae"), F.count("held").alias("n"))


@query("""SELECT vec_id, abs(x - 0.05) <= 0.1 AND abs(y) <= 0.08 AS in_region, sqrt(x * x + y * y) <= 0.15 AS in_radius, abs(x - y) < 0.1 AND abs(z - 0.05) < 0.012 AS stacked,
       least(r, 90 - r) <= 10 AS aligned, sqrt(vx * vx + vy * vy) <= 0.1 AND abs(w) <= 0.1 AS settled
FROM (SELECT *, (a % 90 + 90) % 90 AS r FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE * 900 AS a, embedding[5]::DOUBLE AS vx, embedding[6]::DOUBLE AS vy, embedding[7]::DOUBLE AS w FROM embeddings))""")
def spatial_predicates(spark, sf_dir):
    """In a region, within a radius, stacked, along an axis, settled."""
    x, y, z, a, vx, vy, w = (F.element_at("embedding", i).cast("double") for i in range(1, 8))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", geometry.within_box([x, y], [0.05, 0.0], [0.1, 0.08]).alias("in_region"), (geometry.norm([x, y]) <= 0.15).alias("in_radius"),
        ((F.abs(x - y) < 0.1) & (F.abs(z - 0.05) < 0.012)).alias("stacked"), (geometry.off_axis(a * 900) <= 10).alias("aligned"),
        ((geometry.norm([vx, vy]) <= 0.1) & (F.abs(w) <= 0.1)).alias("settled"),
    )


@query("""SELECT conv_id, role AS key, sha256(arg_max(text, turn)) AS sha FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2""")
def evidence_hashes(spark, sf_dir):
    """A hash for each key of a record's evidence."""
    last = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))
    maps = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("m"))  # a key for each role
    return maps.select("conv_id", F.explode(F.transform_values("m", lambda k, v: F.sha2(v, 256))).alias("key", "sha"))


@query("""SELECT event_id, event_id % 3 <> 2 AS stamped FROM events""")
def stamps_with_offset(spark, sf_dir):
    """Times that name their offset."""
    end = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), end)
    return table(spark, sf_dir, "events").select("event_id", text.has_offset(stamp).alias("stamped"))


@query("""SELECT doc_id, printf('data/chunk-%03d/episode_%06d.parquet', doc_id // 50, doc_id) AS path, source AS task, doc_id::INT AS episode FROM documents WHERE regexp_matches(source, '^[^/]+$')""")
def path_templates(spark, sf_dir):
    """Where an episode lies, and the keys its folder names."""
    d = table(spark, sf_dir, "documents").where(F.col("source").rlike("^[^/]+$"))
    key = files.key_from_path(F.concat(F.lit("/root/"), F.col("source"), F.lit("/episode_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("/meta.json")))
    return d.select("doc_id", files.chunk_path(F.col("doc_id"), 50).alias("path"), key.alias("k")).select("doc_id", "path", "k.task", "k.episode")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'released' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'submitted' ELSE 'completed' END AS status FROM orders""")
def crash_recovery(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in ("reserved", "submitting", "submitted", "completed")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ledger.recovered(status).alias("status"))


@query("""SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN len([k FOR k IN json_keys(props) IF json_type(props, '$.' || k) IN ('BIGINT', 'UBIGINT', 'DOUBLE')]) > 0 ELSE FALSE END AS numeric FROM events""")
def recursive_numeric(spark, sf_dir):
    """Whether a number stands anywhere in a nested value: texts are taken out, then a bare number is looked for."""
    bare = F.regexp_replace("props", r'"(?:[^"\\]|\\.)*"', '""')
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(bare.rlike(r"(?:^|[:,\[{\s])-?[0-9]"), F.lit(False)).alias("numeric"))
