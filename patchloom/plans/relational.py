"""Relational queries on the supplied tables: counting, keeping, splitting, joining, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions.text import strip
from patchloom.operators import dedupe, history, joins, ranking, reports
from patchloom.plans.registry import query, table

PCT = "floor(1000.0 * {0} / {1} + 0.5) / 10.0"


@query(f"SELECT count(*) AS n_ids, CAST(sum(ok) AS BIGINT) AS n_success, CASE WHEN count(*) = 0 THEN -1.0 ELSE {PCT.format('sum(ok)', 'count(*)')} END AS rate FROM (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ok FROM events GROUP BY user_id)")
def plausible_rate(spark, d):
    return reports.plausible_rate(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase")


@query(f"SELECT event_type AS value, count(*) AS n, {PCT.format('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM events GROUP BY event_type")
def value_counts_pct(spark, d):
    return reports.value_counts(table(spark, d, "events"), "event_type")


@query(f"SELECT quality AS value, count(*) AS n, {PCT.format('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_counts_nulls(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return reports.value_counts(joined, "quality")


@query("SELECT lang, count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def nunique_by_group(spark, d):
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("text"), "source")
    return docs.groupBy("lang").agg(F.countDistinct("text").alias("n_texts"), F.countDistinct("source").alias("n_sources"))


@query(None)
def approx_distinct(spark, d):
    """Approximate by construction (5 % error asked for), so rows only."""
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.05).alias("n_users"))


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def keep_latest(spark, d):
    return dedupe.keep_latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id")


@query(f"SELECT count(*) AS n_rows, count(*) - count(DISTINCT text) AS n_duplicates, {PCT.format('(count(*) - count(DISTINCT text))', 'count(*)')} AS pct FROM documents")
def duplicate_rate(spark, d):
    keys = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"))
    total = keys.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_duplicates"))
    return total.withColumn("pct", reports.share(F.col("n_duplicates"), F.col("n_rows")))


@query("SELECT min(doc_id) AS doc_id, md5(lower(trim(text))) AS text_key FROM documents GROUP BY md5(lower(trim(text)))")
def dedup_first(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.lower(F.trim("text")).cast("binary")).alias("text_key"))
    return dedupe.keep_first(keyed, ["text_key"], "doc_id")


@query("""
WITH e AS (SELECT event_id, event_type, user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events),
c AS (SELECT event_type, day, user_id, count(*) AS n FROM e GROUP BY ALL),
a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY day, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, floor(0.8::DOUBLE * sum(n) OVER (PARTITION BY event_type)) AS size FROM c),
s AS (SELECT *, coalesce(max(CASE WHEN pos > 0 AND pos <= size - 1 THEN pos END) OVER (PARTITION BY event_type), min(CASE WHEN pos > 0 THEN pos END) OVER (PARTITION BY event_type)) AS cut FROM a)
SELECT e.event_id, e.event_type, CASE WHEN cut IS NULL OR pos < cut THEN 'train' WHEN row_number() OVER (PARTITION BY e.event_type, e.day, e.user_id ORDER BY event_id) - 1 < floor(0.25::DOUBLE * n) THEN 'valid' ELSE 'test' END AS split
FROM e JOIN s ON e.event_type = s.event_type AND e.day = s.day AND e.user_id = s.user_id""")
def temporal_split(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", F.unix_seconds(F.date_trunc("day", "ts")).alias("day"))
    return ranking.temporal_split(events, "event_type", "day", "user_id", "event_id").select("event_id", "event_type", "split")


@query("SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 < floor(0.25::DOUBLE * count(*) OVER (PARTITION BY user_id)) THEN 'valid' ELSE 'test' END AS split FROM events")
def stratified_split(spark, d):
    ranked = ranking.global_rank(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")])
    return ranked.select("event_id", "user_id", F.when(F.col("rn") < F.floor(F.lit(0.25) * F.col("n")), "valid").otherwise("test").alias("split"))


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r >= floor(n * (1::DOUBLE - 0.8::DOUBLE))")
def train_fraction_old(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return ranking.drop_fraction(orders, "o_orderstatus", [F.col("o_orderdate"), F.col("o_orderkey")], 0.8).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r < n - floor(n * (1::DOUBLE - 0.8::DOUBLE))")
def train_fraction_new(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return ranking.drop_fraction(orders, "o_orderstatus", [F.col("o_orderdate"), F.col("o_orderkey")], -0.8).select("o_orderkey", "o_orderstatus")


@query("SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id) p ON e.user_id = p.user_id WHERE e.event_type = 'error' AND e.ts <= p.t")
def merge_not_newer(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return ranking.merge_not_newer(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "user_id", "ts").select("event_id", "user_id")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def mask_in(spark, d):
    return table(spark, d, "documents").where(F.col("source").isin("src1", "src3", "src5")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src3', 'src5')")
def mask_not_in(spark, d):
    return table(spark, d, "documents").where(~F.col("source").isin("src1", "src3", "src5")).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT i AS doc_id FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM documents))) AS i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def missing_index(spark, d):
    last = table(spark, d, "documents").agg(F.max("doc_id")).first()[0]
    return spark.range(0 if last is None else last + 1).select(F.col("id").alias("doc_id")).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


CASCADE = (("has_text", "length(text) > 0"), ("has_lines", "text LIKE '%' || chr(10) || '%'"), ("not_shouting", "upper(text) <> text"), ("short_enough", "n_chars <= 5000"), ("known_language", "lang IN ('en', 'de')"))


@query(f"""
WITH s AS (SELECT CASE {' '.join(f"WHEN NOT ({c}) THEN {i}" for i, (_, c) in enumerate(CASCADE))} ELSE {len(CASCADE)} END AS step_no FROM documents),
n AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}')" for i, (k, _) in enumerate(CASCADE))}) t(step_no, step))
SELECT CAST(n.step_no AS BIGINT) AS step_no, n.step, CAST(count(s.step_no) AS BIGINT) AS removed, CAST((SELECT count(*) FROM s) - (SELECT count(*) FROM s s2 WHERE s2.step_no <= n.step_no) AS BIGINT) AS remaining FROM n LEFT JOIN s ON n.step_no = s.step_no GROUP BY n.step_no, n.step""")
def filter_cascade(spark, d):
    return reports.filter_cascade(table(spark, d, "documents"), [(name, F.expr(rule)) for name, rule in CASCADE])


@query("SELECT l_orderkey, n, low, high FROM (SELECT l_orderkey, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS low, CAST(max(l_linenumber) AS BIGINT) AS high FROM lineitem GROUP BY l_orderkey) WHERE low >= 1 AND high <= n")
def range_check(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").cast("long").alias("low"), F.max("l_linenumber").cast("long").alias("high"))
    return lines.where(F.col("low").between(1, F.col("n")) & F.col("high").between(1, F.col("n")))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<article>') AND regexp_matches(html, 'class=\"ad\"')")
def two_regex_predicate(spark, d):
    return table(spark, d, "pages").where(F.col("html").rlike("<article>") & F.col("html").rlike('class="ad"')).select("page_id")


@query("SELECT page_id, (url IN (SELECT url FROM pages GROUP BY url HAVING count(*) > 1) OR contains(url, '/en/')) AS flagged FROM pages")
def path_flag(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    known = pages.groupBy(F.col("url").alias("known_url")).agg(F.count("*").alias("n")).where("n > 1").select("known_url")
    joined = pages.join(known, F.col("url") == F.col("known_url"), "left")
    return joined.select("page_id", (F.col("known_url").isNotNull() | F.col("url").contains("/en/")).alias("flagged"))


@query("SELECT CASE WHEN toxic IS NULL THEN 'unknown' WHEN toxic = 1 AND quality = 1 THEN 'valid broken' WHEN toxic = 1 THEN 'broken' ELSE 'ok' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY state")
def three_valued(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return reports.classify(joined, [("unknown", F.col("toxic").isNull()), ("valid broken", (F.col("toxic") == 1) & (F.col("quality") == 1)), ("broken", F.col("toxic") == 1)], "ok", "state")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1 AND avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) >= 0.25)")
def group_suppress(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    kept = reports.having(events, ["user_id"], ~((F.col("n") > 1) & (F.col("bad") >= 0.25)), n=F.count("*"), bad=F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)))
    return kept.select("event_id", "user_id")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_join_default(spark, d):
    sums = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    joined = table(spark, d, "customer").select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce(F.round("t", 2), F.lit(0.0)).alias("total"))


def _match(spark, d, last):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    users = events.select("user_id").distinct()
    return joins.match_join(users, events, "user_id", F.struct("ts", "event_id"), ["event_id", "event_type"], last)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_match_join(spark, d):
    return _match(spark, d, False)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_match_join(spark, d):
    return _match(spark, d, True)


@query("""
WITH s AS (SELECT s_nationkey AS k, min(s_suppkey) AS depth FROM supplier GROUP BY s_nationkey),
c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey ELSE CAST(c_custkey % 40 AS INTEGER) END AS k FROM customer)
SELECT c_custkey, coalesce(s.depth, (SELECT max(depth) FROM s)) AS depth FROM c LEFT JOIN s ON c.k = s.k""")
def conditional_key_join(spark, d):
    depth = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("depth"))
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).otherwise((F.col("c_custkey") % 40).cast("int")).alias("k"))
    return rows.join(depth, "k", "left").select("c_custkey", F.coalesce("depth", depth.agg(F.max("depth")).scalar()).alias("depth"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def double_semi(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(lines.where("l_returnflag = 'N'"), "o_orderkey", "left_semi")


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1995),
c AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'missing' AS side, k FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'new' AS side, k FROM o WHERE k NOT IN (SELECT k FROM c)""")
def anti_both_ways(spark, d):
    ordered = table(spark, d, "orders").where("o_orderstatus = 'F' AND year(o_orderdate) = 1995").select(F.col("o_custkey").alias("k")).distinct()
    customers = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    only = lambda side, a, b: a.join(b, "k", "left_anti").select(F.lit(side).alias("side"), "k")
    return only("missing", customers, ordered).unionByName(only("new", ordered, customers))


@query("SELECT a.conv_id, a.turn, b.turn AS next_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 AND a.role = b.role WHERE a.text IS NULL OR b.text IS NULL OR a.text <> b.text")
def changed_pairs(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    later = turns.select("conv_id", "role", F.col("turn").alias("next_turn"), (F.col("turn") - 2).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(later, ["conv_id", "turn", "role"]).where(history.is_modified(F.col("text"), F.col("next_text"))).select("conv_id", "turn", "next_turn")


@query("""
WITH s AS (SELECT DISTINCT p_size * 3 AS p_size FROM part), q AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS quantity FROM lineitem)
SELECT quantity, coalesce((SELECT min(p_size) FROM s WHERE p_size >= quantity), 999) AS chosen FROM q""")
def nearest_at_least(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("quantity")).distinct()
    return joins.nearest_at_least(wanted, "quantity", table(spark, d, "part").select((F.col("p_size") * 3).alias("p_size")), "p_size", 999, "chosen")


@query("""
WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/$', '') AS path FROM pages),
u AS (SELECT page_id, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS up FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS k FROM p)),
h AS (SELECT DISTINCT regexp_replace(path, '/[^/]*/[^/]*$', '') AS have FROM p)
SELECT p.page_id, m.ancestor FROM p LEFT JOIN (SELECT page_id, arg_max(up, length(up)) AS ancestor FROM u JOIN h ON u.up = h.have GROUP BY page_id) m ON p.page_id = m.page_id""")
def longest_prefix(spark, d):
    bare = F.substring_index(F.substring_index(F.substring_index("url", "://", -1), "?", 1), "#", 1)
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(bare, "/$", "").alias("path"))
    known = pages.select(F.regexp_replace("path", "/[^/]*/[^/]*$", "").alias("have"))
    return joins.longest_prefix(pages, "path", "page_id", known, "have").select("page_id", "ancestor")


@query("SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n_e, lang FROM documents")
def evaluate_distinct(spark, d):
    """The feature is computed once for each distinct text and joined back by the text's digest."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.sha2("text", 256).alias("k"))
    feature = docs.groupBy("k").agg(F.any_value("text").alias("t")).select("k", (F.length("t") - F.length(F.replace("t", F.lit("e"), F.lit("")))).cast("long").alias("n_e"))
    return docs.select("doc_id", "lang", "k").join(feature, "k").select("doc_id", "n_e", "lang")


@query("SELECT u.conv_id, u.turn, a.turn AS answer_turn, length(a.text) AS answer_length FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def pair_join_by_key(spark, d):
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn")
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("answer_turn"), F.length("text").cast("long").alias("answer_length"))
    return asked.join(answered, ["conv_id", "turn"])


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, n_chars DESC, doc_id) - 1 AS rank FROM documents")
def multi_key_rank(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return ranking.global_rank(docs, "lang", [F.col("source"), F.col("n_chars").desc(), F.col("doc_id")], "rank").select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_group(spark, d):
    top = ranking.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || '|1234') AS place FROM documents")
def hash_shuffle(spark, d):
    """A seeded order of all rows that no partitioning changes."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|1234")), 256).alias("place")).orderBy("place")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, md5(line) AS line_key, count(*) AS n FROM l GROUP BY doc_id, md5(line) HAVING count(*) > 1")
def occurrence_repeat(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", F.md5(F.col("line").cast("binary")).alias("line_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT CASE WHEN length(text) < 200 THEN 'Originally Empty' WHEN text = upper(text) THEN 'All Test Source' WHEN contains(text, '|') AND contains(text, '!!') THEN 'Combination of Both' WHEN contains(text, '|') THEN 'Preproccessing' ELSE 'Not Found' END AS reason, count(*) AS n FROM documents GROUP BY reason")
def reason_histogram(spark, d):
    text = F.col("text")
    cases = [("Originally Empty", F.length(text) < 200), ("All Test Source", text == F.upper(text)), ("Combination of Both", text.contains("|") & text.contains("!!")), ("Preproccessing", text.contains("|"))]
    return reports.classify(table(spark, d, "documents"), cases, "Not Found")


@query("SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n_lines FROM (SELECT o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def nested_sum(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    joined = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(F.sum(F.coalesce(F.size(F.coalesce("lines", F.array().cast("array<int>"))), F.lit(0))).alias("n_lines"))


@query("""
WITH e AS (SELECT CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS epoch, floor(avg(value) * 1000 + 0.5) / 1000 AS loss FROM events GROUP BY 1)
SELECT epoch, loss, min(loss) OVER (ORDER BY epoch) AS best_so_far, epoch = (SELECT arg_min(epoch, (loss, epoch)) FROM e) AS is_best FROM e""")
def best_epoch(spark, d):
    from pyspark.sql import Window

    day = F.floor(F.unix_seconds(F.date_trunc("day", "ts")) / 86400).alias("epoch")
    epochs = table(spark, d, "events").groupBy(day).agg((F.floor(F.avg("value") * 1000 + 0.5) / 1000).alias("loss"))
    best = epochs.agg(F.min_by("epoch", F.struct("loss", "epoch"))).scalar()
    running = F.min("loss").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return epochs.select("epoch", "loss", running.alias("best_so_far"), (F.col("epoch") == best).alias("is_best"))


@query("SELECT event_type AS category, count(DISTINCT user_id) AS n_users, CAST(min(user_id) AS BIGINT) AS first_user FROM events GROUP BY event_type")
def error_sets(spark, d):
    sets = table(spark, d, "events").select("event_type", "user_id").distinct().groupBy(F.col("event_type").alias("category"))
    return sets.agg(F.count("*").alias("n_users"), F.min("user_id").alias("first_user"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE quality = 1")
def union_all(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").unionByName(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def union_missing(spark, d):
    """Rows of both tables; a column that one lacks is null there."""
    return table(spark, d, "documents").select("doc_id", "lang").unionByName(table(spark, d, "labels").select("doc_id", "quality"), allowMissingColumns=True)


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE quality = 1")
def union_distinct(spark, d):
    return union_all(spark, d).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def except_ids(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").subtract(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersect_ids(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def xml_field(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
b AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 3)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY node""")
def bfs_depth(spark, d):
    """Depths over the edges of all line items."""
    from patchloom.operators.graph import bfs_depth as bfs

    lines = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    edges = lines.unionByName(lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return bfs(edges, spark.range(1).select(F.lit("s1").alias("root")), 3).select("node", F.col("depth").cast("long").alias("depth"))


@query("SELECT s.c_custkey, s.c_acctbal, CASE WHEN trim(s.c_name) = '' THEN NULL ELSE trim(s.c_name) END AS name FROM customer s WHERE s.c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def semi_join_filter(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_acctbal", F.nullif(strip(F.col("c_name")), F.lit("")).alias("name"))
