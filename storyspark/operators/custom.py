"""Queries whose operators SQL cannot express (grouped maps, iterations, models); those with an oracle say so in ``ORACLES``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyspark.functions import cjk, sequences, spans
from storyspark.functions import series as S
from storyspark.operators import graph_algorithms as G
from storyspark.operators import aliases, chapters, communities, dependency, foreshadowing, forest, learning, ordering, paragraphs, series, skipgram, summaries
from storyspark.operators.facts import FRACTION
from storyspark.operators.text_metrics import SIGMOID, tension
from storyspark.plans.dialect import LEXICONS, TOKEN, Dialect
from storyspark.sources import contributions, vector_index
from storyspark.streaming import outbox, subscription


def _sql(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    d = Dialect("spark", sf_dir)
    return spark.sql(d.finish(build(d)))


def _points(spark, sf_dir):
    return _sql(spark, sf_dir, lambda d: f"WITH {d.paragraphs()}, w AS (SELECT doc_id, pid, chars, CAST(pos - neg AS DOUBLE) / greatest(tok, 1) AS net, sum(chars) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - chars / 2e0 AS mid, sum(chars) OVER (PARTITION BY doc_id) AS total FROM para) SELECT doc_id, pid, chars, net, mid / total AS x FROM w")


def _tension(spark, sf_dir):
    return _sql(spark, sf_dir, lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, avg({SIGMOID}) AS v, sum(CASE WHEN z_c3 > 0 THEN 1 ELSE 0 END) AS conflicts, sum(CASE WHEN z_c1 > 0 THEN 1 ELSE 0 END + CASE WHEN z_c2 > 0 THEN 1 ELSE 0 END) AS flags FROM z GROUP BY doc_id, ch) SELECT doc_id, ch, v, conflicts, flags, CAST(ch AS DOUBLE) / max(ch) OVER (PARTITION BY doc_id) AS x FROM t")


def paragraph_curves(spark, sf_dir):
    return series.curves(_points(spark, sf_dir), "doc_id", "x", "net", "chars").select("doc_id", F.round("x", 6).alias("x"), F.round("net", 6).alias("net"), F.round("smoothed", 6).alias("smoothed"))


def curve_sampling(spark, sf_dir):
    return series.downsample(_points(spark, sf_dir), "doc_id", "x", "net", 40)


def three_act_structure(spark, sf_dir):
    return series.three_acts(_tension(spark, sf_dir), "doc_id", "x", "v", "conflicts", "flags")


def four_phases(spark, sf_dir):
    return series.four_phases(_tension(spark, sf_dir), "doc_id", "x", "v")


def spaced_peaks(spark, sf_dir):
    return series.spaced_peaks(_tension(spark, sf_dir), "doc_id", "x", "v")


def monotone_positions(spark, sf_dir):
    return series.monotone_positions(_points(spark, sf_dir), "doc_id", "x")


def _documents(spark, sf_dir, *cols):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *cols)


def _map_text(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows (doc_id, *fn(text)) of every text."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows = [(d, *r) for d, t in zip(pdf["doc_id"], pdf["text"]) for r in fn(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    return df.mapInPandas(run, f"doc_id long, {schema}")


def chapter_parse(spark, sf_dir):
    return chapters.parse(_documents(spark, sf_dir, "text"))


def dialogue_spans(spark, sf_dir):
    return _map_text(_documents(spark, sf_dir, "text"), cjk.dialogue_spans, "start int, stop int, closed boolean")


def negation_sentiment(spark, sf_dir):
    return _map_text(_documents(spark, sf_dir, "text"), lambda t: [cjk.sentiment(t, [f" {w} " for w in LEXICONS["pos"]], [f" {w} " for w in LEXICONS["neg"]])], "pos long, neg long")


def fixed_phrases(spark, sf_dir):
    automaton = spark.sparkContext.broadcast(spans.Automaton(["licensed under", "license"]))
    return _map_text(_documents(spark, sf_dir, "text"), lambda t: spans.fixed_phrases(t, automaton.value), "start int, stop int, kind string")


def turn_containment(spark, sf_dir):
    """How much of every turn the turn before it holds in order (null where the turn is short or the first)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.round(sequences.contained(F.col("text"), F.col("before")), 6).alias("ratio"))


def mtld(spark, sf_dir):
    toks = _documents(spark, sf_dir, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))

    @F.pandas_udf("double")
    def measure(t: pd.Series) -> pd.Series:
        return t.map(lambda x: S.mtld(list(x)))

    return toks.select("doc_id", F.round(measure("tokens"), 6).alias("mtld"))


def fuzzy_hits(spark, sf_dir):
    """Distinct tokens of a document within one edit of a term, terms themselves aside."""
    toks = _documents(spark, sf_dir, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("tk"))
    vocabulary = toks.select("tk").distinct()
    terms = spark.createDataFrame([("ersterh",), ("token",), ("license",)], "term string")
    near = vocabulary.join(F.broadcast(terms), F.levenshtein("tk", "term", 1) >= 0).where("tk <> term").select("tk").distinct()
    return toks.join(near, "tk").groupBy("doc_id").agg(F.count("*").alias("fuzzy_hits"))


def _edges(spark, sf_dir):
    return _sql(spark, sf_dir, lambda d: f"WITH {d.edges()} SELECT a, b, w FROM edge")


def pagerank(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("node"))
    return G.pagerank(_edges(spark, sf_dir), nodes).select("node", F.round("rank", 6).alias("rank"))


def hits(spark, sf_dir):
    return G.hits(_edges(spark, sf_dir)).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


def louvain(spark, sf_dir):
    return communities.louvain(_edges(spark, sf_dir)).withColumn("run", F.lit(0))


def components(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return G.components(o.select(F.col("o_custkey").alias("a"), (F.lit(1 << 40) + F.col("o_orderkey")).alias("b")))


def component_summary(spark, sf_dir):
    """Number of components and size of the largest."""
    return components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def identity_components(spark, sf_dir):
    """A user and the accounts of all signups are the same, two accounts signed up in succession on one day are different."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'").select("user_id", (F.lit(1 << 40) + F.col("event_id")).alias("account"), "event_id", "ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pair = e.select(F.lag("account").over(order).alias("a"), F.col("account").alias("b"), (F.to_date(F.lag("ts").over(order)) == F.to_date("ts")).alias("near"))
    return G.identity_components(e.select(F.col("user_id").alias("a"), F.col("account").alias("b")), pair.where("near").select("a", "b"), spark.range(0, 100, 17).toDF("node"))


def textrank(spark, sf_dir):
    """The 20 top words of the graph of words of two characters or more that share a window of five tokens."""
    return G.textrank_texts(_documents(spark, sf_dir, "text")).orderBy(F.desc("rank"), "node").limit(20).select("node", F.round("rank", 6).alias("rank"))


def _tokens(spark, sf_dir):
    return _documents(spark, sf_dir, F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) >= 2).alias("tokens"))


def _texts(spark, sf_dir):
    """The texts of ``_tokens``, which the topic models split themselves."""
    return _documents(spark, sf_dir, F.lower("text").alias("tokens"))


def lda_topics(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    words = learning.dictionary(docs)
    bags = G.cut(learning.bags(docs, words).drop("tokens"))
    model = learning.fit_bags(bags, k=learning.topic_count(None, bags.count(), most=8))
    return learning.infer_bags(bags, model).select("doc_id", "status", "n_tokens", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


def lda_topic_words(spark, sf_dir):
    words, model = learning.fit_lda(_texts(spark, sf_dir), k=5)
    return learning.topic_words(words, model)


def _word_vectors(spark, sf_dir, min_count):
    """(word, vector) from scratch, in one epoch; Spark ML trains those of a vocabulary that is too large to be broadcast."""
    try:
        return skipgram.train(_texts(spark, sf_dir), 16, min_count=min_count, epochs=1, rate=0.025).vectors.select("word", "vector")
    except skipgram.TooManyWords:
        return learning.fit_word2vec(_tokens(spark, sf_dir), size=16, min_count=min_count)


def word2vec(spark, sf_dir):
    return _word_vectors(spark, sf_dir, 2)


def ridge_boundary(spark, sf_dir):
    fit = learning.ridge(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "label")
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(fit[0] + [fit[1]])] if fit else [], "place int, weight double")


def outbox_projection(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return outbox.project_batch(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(";")).alias("text")))


def outbox_stream(spark, sf_dir):
    """The projection over the log as a file stream, run to its end: the last row of each run (one of an expired state starts anew)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream takes a folder only: the table may be a file or a folder of files
    log = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    log = log.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(";")).alias("text"), "ts")
    folder = G.new_path(spark)
    write = outbox.project(log).writeStream.outputMode("update").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True)
    write.foreachBatch(lambda df, _: df.write.mode("append").parquet(folder)).start().awaitTermination()
    return spark.read.schema(outbox.OUT).parquet(folder).groupBy("run_id").agg(F.max_by(F.struct("last_seq", "messages", "tail"), "last_seq").alias("s")).select("run_id", "s.*")


def trailing_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = outbox.trailing_health(e.select(F.col("event_type").alias("model"), "ts", (F.col("value") > 20).alias("failed")), slide="10 minutes")
    return out.select("model", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "turns", "failures")


# whole-table orders and forests: the SQL texts of the same names are their oracles ------------------------------------


def containment_roots(spark, sf_dir):
    """Root and depth of every event in the forest of parents event_id // 10, by pointer doubling: as many joins as the depth has bits."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    at = G.cut(e.withColumn("root", F.when(F.col("id") >= 10, F.expr("id div 10")).otherwise(F.col("id"))).withColumn("depth", (F.col("id") >= 10).cast("long")))
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = G.cut(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        at = step.select("id", "root", "depth")
        if step.where("moved").isEmpty():
            return at


def interval_overlap(spark, sf_dir):
    """Other customers' order spans that overlap a customer's: spans that start before its end, less those that end by its start.

    Both counts are running sums over the starts and ends in order; spans of one order, whose ends are equal, count as in the definition.
    """
    iv = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("s"), F.max("o_orderkey").alias("e"))
    # at a place: ends of real spans, questions (what started before it; for points, what ended by it), starts and ends of points, what ended by it
    marks = F.array(
        F.struct(F.col("s").alias("v"), F.when(F.col("s") < F.col("e"), 3).otherwise(1).alias("t"), F.lit("ended").alias("kind"), F.lit(0).alias("started"), F.lit(0).alias("over")),
        F.struct(F.col("e").alias("v"), F.lit(1).alias("t"), F.lit("begun").alias("kind"), F.lit(0).alias("started"), F.lit(0).alias("over")),
        F.struct(F.col("s").alias("v"), F.lit(2).alias("t"), F.lit("").alias("kind"), F.lit(1).alias("started"), F.lit(0).alias("over")),
        F.struct(F.col("e").alias("v"), F.when(F.col("s") < F.col("e"), 0).otherwise(2).alias("t"), F.lit("").alias("kind"), F.lit(0).alias("started"), F.lit(1).alias("over")),
    )
    rows = iv.select("k", F.explode(marks).alias("m")).select("k", "m.*")
    order = [F.col("v"), F.col("t"), F.col("k"), F.col("kind"), F.col("started"), F.col("over")]
    rows = ordering.running(ordering.running(rows, order, "starts", F.col("started")), order, "ends", F.col("over"))
    told = rows.groupBy("k").agg(F.max(F.when(F.col("kind") == "begun", F.col("starts"))).alias("starts"), F.max(F.when(F.col("kind") == "ended", F.col("ends"))).alias("ends"))
    out = told.join(iv, "k").select("k", (F.col("starts") - F.col("ends") - (F.col("s") < F.col("e")).cast("long")).cast("long").alias("overlaps"))
    return out.where("overlaps > 0")


def event_sort(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(~(F.col("value") > 30) | F.col("value").isNull(), F.col("value")).alias("v"))
    return ordering.numbered(e, [F.col("v").asc_nulls_last(), F.col("event_id")], "place").select("event_id", "place")


def action_order(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("entity"), F.day("ts").alias("ch"), F.coalesce(F.when(F.col("event_type") == "view", F.col("event_id")), F.lit(2147483648)).alias("first"))
    return ordering.numbered(log, [F.col("ch"), F.col("first"), F.col("entity"), F.col("event_id")]).select("event_id", (F.col("rn") - 1).alias("ordinal"))


def run_paragraph_identity(spark, sf_dir):
    p = _sql(spark, sf_dir, lambda d: d.explode("doc_id", d.lines("text"), "@documents", "pid", "txt"))
    n = p.groupBy("doc_id").agg(F.count("*").alias("n"))
    base = ordering.running(n, [F.col("doc_id")], "up_to", F.col("n")).select("doc_id", (F.col("up_to") - F.col("n")).alias("base"))
    return p.join(base, "doc_id").select("doc_id", "pid", (F.col("base") + F.col("pid")).cast("long").alias("paragraph_id"))


def weighted_roulette(spark, sf_dir):
    w = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select("s_suppkey", F.col("s_acctbal").alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    up_to = ordering.running(w, [F.col("s_suppkey")], "hi", F.col("w"))
    return up_to.join(F.broadcast(total)).where(F.col("hi") >= F.lit(FRACTION) * F.col("total")).agg(F.min("s_suppkey").alias("chosen"))


def topic_evolution(spark, sf_dir):
    unit = _sql(spark, sf_dir, lambda d: f"WITH {d.topics()} SELECT pid, tok FROM unit")
    topic = _sql(spark, sf_dir, lambda d: f"WITH {d.topics()} SELECT pid, topic, w FROM topic")
    at = ordering.running(unit, [F.col("pid")], "up_to", F.col("tok")).join(F.broadcast(unit.agg(F.sum("tok").alias("total"))))
    at = at.select("pid", "tok", F.floor((F.col("up_to") - F.col("tok")) * 16 / F.col("total")).cast("long").alias("bucket"))
    return at.join(topic, "pid").groupBy("bucket", "topic").agg(F.round(F.sum(F.col("w") * F.col("tok")) / F.sum("tok"), 6).alias("weight"))


def event_timeline_levels(spark, sf_dir):
    """Users by the thirds of their importance, which is rounded as a double (Spark's round takes it for a decimal) and adds values in the order of events, as one halfway between two hundredths hangs on its last digit."""
    run = lambda x: f"{x} OVER (PARTITION BY user_id ORDER BY event_id, value)"
    s = _sql(spark, sf_dir, lambda d: f"SELECT user_id, round((CAST(0.4 * n AS DOUBLE) / 100 + 0.3D * (total / filled) / 50) * 100) / 100 AS importance FROM (SELECT user_id, {run('row_number()')} AS n, {run('count(value)')} AS filled, {run('sum(value)')} AS total, {run('lead(true)')} AS more FROM @events) t WHERE more IS NULL")
    s = ordering.numbered(s, [F.col("importance").asc_nulls_last(), F.col("user_id").asc_nulls_last()], "i")
    n = s.agg(F.count("*").alias("n"))
    cut = s.join(F.broadcast(n)).agg(*[F.max(F.when(F.col("i") == F.expr(f"n * {q} div 100 + 1"), F.col("importance"))).alias(name) for name, q in (("hi", 66), ("lo", 33))])
    level = F.when(F.col("importance") >= F.col("hi"), "major").when(F.col("importance") >= F.col("lo"), "minor").otherwise("detail")
    return s.join(F.broadcast(cut)).select("user_id", "importance", level.alias("level"))


def emotion_spans(spark, sf_dir):
    """Where the terms of all word lists stand in every document."""
    return spans.emotion_spans(_documents(spark, sf_dir, "text"), [t for words in LEXICONS.values() for t in words], TOKEN)


def alias_pairs(spark, sf_dir):
    """Pairs of nations, customers, suppliers and parts of which one's name is inside the other's."""
    return aliases.containment_pairs(_sql(spark, sf_dir, lambda d: ENTITIES))


ENTITIES = "SELECT 'n' || n_nationkey AS id, n_name AS name FROM @nation UNION ALL SELECT 'c' || c_custkey, c_name FROM @customer UNION ALL SELECT 's' || s_suppkey, s_name FROM @supplier UNION ALL SELECT 'p' || p_partkey, p_name FROM @part"


def _forest(spark, sf_dir):
    """The log as a forest up to day 15: a user's events of one day are a tree (one under the other), an error runs into the next day, successive
    events are causal unless the first is a view, and views, clicks and purchases set up, reinforce and pay off what a user's first event began."""
    e = _sql(spark, sf_dir, lambda d: f"WITH {FOREST} SELECT * FROM ev")
    events = e.select("event_id", F.col("ch").alias("chapter"), F.col("ch").alias("from_chapter"), F.col("until").alias("to_chapter"), F.col("event_id").alias("char_start"), (F.col("event_id") + 1).alias("char_end"))
    links = e.where("nxt is not null").select(F.col("event_id").alias("relation_id"), F.col("event_id").alias("source"), F.col("nxt").alias("target"), F.when(F.col("event_type") != "view", "causal").otherwise("contrast").alias("type"), F.explode(F.array("ch", "nxt_ch")).alias("chapter"))
    action = F.create_map(*map(F.lit, ("view", "setup", "click", "reinforce", "purchase", "payoff")))[F.col("event_type")]
    actions = e.select(F.col("first").alias("source"), F.when(action == "payoff", F.col("event_id")).alias("target"), action.alias("action"), F.col("ch").alias("chapter"), F.col("event_id").alias("ord")).where("action is not null")
    return forest.snapshot(
        events, e.select(F.col("event_id").alias("owner"), F.col("ch").alias("chapter")), e.where("parent is not null").select(F.col("event_id").alias("id"), "parent"),
        links.select("relation_id", "source", "target", "type").distinct(), links.select(F.col("relation_id").alias("owner"), "chapter"), actions, 15,
    )


FOREST = "ev AS (SELECT event_id, event_type, ch, CASE WHEN event_type = 'error' THEN ch + 1 ELSE ch END AS until, lag(event_id) OVER (PARTITION BY user_id, ch ORDER BY ts, event_id) AS parent, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lead(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt_ch, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM (SELECT *, CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS ch FROM @events) t)"


def event_forest(spark, sf_dir):
    return _forest(spark, sf_dir).nodes.select("event_id", "tree_id", "parent_event_id", "cause_role", "event_ordinal")


def event_forest_trees(spark, sf_dir):
    return _forest(spark, sf_dir).trees.select("tree_id", F.array_join("chapters", ",").alias("chapters"), "char_start", "char_end", "nodes")


def event_forest_edges(spark, sf_dir):
    return _forest(spark, sf_dir).edges


def event_forest_threads(spark, sf_dir):
    return _forest(spark, sf_dir).threads


def api_event_trees(spark, sf_dir):
    """The first 20 trees by place, with the state of the thread that their root began."""
    f = _forest(spark, sf_dir)
    page = f.trees.orderBy("char_start", "tree_id").limit(20)
    return page.join(f.threads, page["tree_id"] == f.threads["root_event_id"], "left").select("tree_id", F.array_join("chapters", ",").alias("chapters"), "nodes", "status")


def vector_index_topk(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 20, by an inverted-file index over all vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = G.new_path(spark)
    vector_index.build(v, path, 64)
    return vector_index.search(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), path).select("qid", "id", "place", F.round("cosine", 6).alias("cosine"))


def _consumed(spark, sf_dir):
    """The folder of a consumer that the log has reached in four parts of successive messages: it is started anew for each, and each is a batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("m"), "event_id").alias("message_key"), F.concat("event_type", F.lit(";")).alias("text"))
    folder, top = G.new_path(spark), e.agg(F.max("seq")).first()[0] or 0
    for part in range(4):
        e.where(F.expr(f"seq * 4 div {top + 1}") == part).write.parquet(f"{folder}/in/{part}")
        log = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        subscription.consume(log, f"{folder}/sink").awaitTermination()
    return f"{folder}/sink"


def durable_consumer(spark, sf_dir):
    """Every run's state after the whole log has gone through the consumer in four batches."""
    return subscription.connect(spark, _consumed(spark, sf_dir))[0]


def subscription_deltas(spark, sf_dir):
    """Of a subscription at the second of four batches: each run's cursor, and how many messages came after it, up to which."""
    folder = _consumed(spark, sf_dir)
    snapshot, at = subscription.connect(spark, folder, 1)
    more = subscription.deltas(spark, folder, at).groupBy("run_id").agg(F.count("*").alias("more"), F.max("seq").alias("up_to"))
    return snapshot.select("run_id", F.col("last_seq").alias("cursor")).join(more, "run_id", "full_outer").select("run_id", "cursor", F.coalesce("more", F.lit(0)).alias("more"), "up_to")


def contribution_replay(spark, sf_dir):
    """Facts of all orders, contributed by the market segments of their customers, twice: rows, entities and what each write appended."""
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("producer"), F.col("c_name").alias("name"), F.col("o_orderkey").alias("fact"))
    path, dims = G.new_path(spark), {"entity": ["name"]}
    first, second = contributions.contribute(facts, path, dims), contributions.contribute(facts, path, dims)
    stored = spark.read.parquet(f"{path}/facts").groupBy("producer").agg(F.count("*").alias("stored"), F.count_distinct("entity_id").alias("entities"))
    return first.join(second.select("producer", F.col("appended").alias("appended_again")), "producer").join(stored, "producer").select("producer", "rows", "appended", "appended_again", "stored", "entities")


def dependency_depth(spark, sf_dir):
    """Depth statistics of orders read as sentences: lines, by part and supplier, are tokens, and a line's head is the token that its part points to."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))).alias("t"))
    rows = rows.select("l_orderkey", F.transform("t", lambda x: (x["l_partkey"] % (F.size("t") + 2)).cast("int")).alias("h"), F.transform("t", lambda x: F.concat(F.lit("r"), (x["l_suppkey"] % 3).cast("string"))).alias("r"))
    out = dependency.statistics(rows, "h", "r")
    return out.select("l_orderkey", *[F.col(c).cast("long").alias(c) for c in ("n_nodes", "n_roots", "depth_sum", "depth_max")], F.coalesce(F.col("relation_counts")["r0"], F.lit(0)).cast("long").alias("r0"))


def word2vec_warm(spark, sf_dir):
    """Word vectors trained on from those of a first training: how far each word moved."""
    given = _word_vectors(spark, sf_dir, 5)
    out = skipgram.train(_texts(spark, sf_dir), 16, given, epochs=1).vectors
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = out.join(given.select("word", F.col("vector").cast("array<double>").alias("given")), "word", "left")
    return both.select("word", "known", F.round(dot("vector", "given") / F.sqrt(dot("vector", "vector") * dot("given", "given")), 6).alias("kept"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def topic_model_artifact(spark, sf_dir):
    """Inference by a topic model that was saved and loaded again."""
    docs, path = _texts(spark, sf_dir), G.new_path(spark)
    learning.save_topic_model(spark, path, *learning.fit_lda(docs, k=5), labels={0: "first"})
    loaded = learning.load_topic_model(spark, path)
    out = learning.infer_lda(docs, loaded.words, loaded.model)
    return out.select("doc_id", "status", "n_tokens", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"), F.lit(loaded.reason).cast("string").alias("reason"))


def paragraph_spans(spark, sf_dir):
    return paragraphs.split(_documents(spark, sf_dir, "text")).withColumn("text", F.md5("text"))


def _chapter_labels(spark, sf_dir):
    """Paragraphs, and labels of chapters: those of the document, for its first and every labelled quality for its other chapters."""
    para = _sql(spark, sf_dir, lambda d: f"WITH {d.paragraphs()} SELECT * FROM para")
    return para, _sql(spark, sf_dir, lambda d: f"WITH {d.paragraphs()} {CHAPTER_LABELS}")


CHAPTER_LABELS = "SELECT DISTINCT p.doc_id, p.ch, CASE WHEN l.quality = 1 THEN 'turn' WHEN p.ch = 1 THEN 'setup' ELSE '' END AS narrative_function, CASE WHEN p.ch > 1 THEN l.toxic = 1 END AS pivot_moment, l.quality = 1 AS cliffhanger, CASE WHEN p.ch <> 2 THEN l.quality - l.toxic END AS emotional_valence FROM para p JOIN @labels l ON p.doc_id = l.doc_id"


def chapter_summary(spark, sf_dir):
    return summaries.chapter_summary(*_chapter_labels(spark, sf_dir), with_mtld=False)


def book_summary(spark, sf_dir):
    out = summaries.book_summary(*_chapter_labels(spark, sf_dir), with_mtld=False)
    for c in ("function_share", "valence_share"):  # as text, in order of the labels
        out = out.withColumn(c, F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), F.format_number(e["value"], 4))), ","))
    return out


def book_statistics(spark, sf_dir):
    rows = _sql(spark, sf_dir, lambda d: f"WITH {tension(d)} SELECT p.doc_id, p.ch, p.pid, p.txt, p.chars, p.tok, p.pos, p.neg, CASE WHEN p.tok > 0 THEN CAST(p.pos - p.neg AS DOUBLE) / p.tok END AS net, round({SIGMOID}, 9) AS tension FROM para p JOIN z ON p.doc_id = z.doc_id AND p.pid = z.pid")
    return summaries.book_statistics(rows, with_mtld=False)


def _foreshadowing(spark, sf_dir):
    """The log's actions (as in the forest), and its roots: the first events of users, as likely to pay off as their value is high."""
    e = _sql(spark, sf_dir, lambda d: f"WITH {FOREST} SELECT ev.*, value FROM ev JOIN (SELECT event_id AS id, value FROM @events) v ON ev.event_id = v.id")
    action = F.create_map(*map(F.lit, ("view", "setup", "click", "reinforce", "purchase", "payoff")))[F.col("event_type")]
    actions = e.select(F.col("first").alias("root"), action.alias("action"), F.when(action == "payoff", F.col("event_id")).alias("target"), F.col("ch").alias("chapter"), F.col("event_id").alias("ord")).where("action is not null")
    likelihood = F.when(F.col("value") > 40, "high").when(F.col("value") > 20, "medium").when(F.col("value") > 5, "low")
    roots = e.where("event_id = first").select(F.col("ch").alias("run"), F.col("event_id").alias("root"), likelihood.alias("likelihood"), F.col("event_id").alias("ord"))
    return roots, actions


def foreshadow_trees(spark, sf_dir):
    return foreshadowing.trees(_foreshadowing(spark, sf_dir)[1]).withColumn("chapters", F.array_join("chapters", ","))


def foreshadow_expectation(spark, sf_dir):
    """What may be expected of the roots of each day."""
    return foreshadowing.expectation(*_foreshadowing(spark, sf_dir))


def api_diagnosis(spark, sf_dir):
    """Threads with the expectation of the day on which they began."""
    roots, actions = _foreshadowing(spark, sf_dir)
    t = foreshadowing.trees(actions).join(roots.select("root", "run"), "root")
    return t.join(foreshadowing.expectation(roots, actions), "run").select("root", F.array_join("chapters", ",").alias("chapters"), "status", "expectation")


QUERIES = {f.__name__: f for f in (
    foreshadow_trees, foreshadow_expectation, api_diagnosis,
    book_statistics,
    chapter_summary, book_summary,
    paragraph_spans,
    word2vec_warm, topic_model_artifact, turn_containment,
    dependency_depth,
    durable_consumer, subscription_deltas, contribution_replay,
    vector_index_topk, emotion_spans, alias_pairs, event_forest, event_forest_trees, event_forest_edges, event_forest_threads, api_event_trees,
    paragraph_curves, curve_sampling, three_act_structure, four_phases, spaced_peaks, monotone_positions, chapter_parse, dialogue_spans, negation_sentiment, fixed_phrases, mtld, fuzzy_hits,
    pagerank, hits, louvain, components, component_summary, identity_components, textrank, lda_topics, lda_topic_words, word2vec, ridge_boundary, outbox_projection, outbox_stream, trailing_windows,
    containment_roots, interval_overlap, event_sort, action_order, run_paragraph_identity, weighted_roulette, topic_evolution, event_timeline_levels,
)}


def _hits_sql(d: Dialect) -> str:
    """Thirty rounds of authority from hub from authority, spelt out (its sixth decimals stand long before), then the hubs."""
    pull = lambda x: f"SELECT u AS node, sum(x * w) AS x FROM bw JOIN {x} ON bw.v = {x}.node GROUP BY u"
    steps, at = [], "a0"
    for i in range(1, 31):
        steps.append(f"h{i} AS MATERIALIZED ({pull(at)}), r{i} AS MATERIALIZED ({pull(f'h{i}')}), a{i} AS MATERIALIZED (SELECT node, x / (SELECT sum(x) FROM r{i}) AS x FROM r{i})")
        at = f"a{i}"
    return f"WITH {d.edges()}, bw AS MATERIALIZED (SELECT a AS u, b AS v, CAST(w AS DOUBLE) AS w FROM edge UNION ALL SELECT b AS u, a AS v, CAST(w AS DOUBLE) AS w FROM edge), a0 AS (SELECT DISTINCT u AS node, 1e0 AS x FROM bw), {', '.join(steps)}, hub AS MATERIALIZED ({pull(at)}) SELECT {at}.node, round(hub.x / (SELECT sum(x) FROM hub), 6) AS hub, round({at}.x, 6) AS authority FROM {at} JOIN hub ON hub.node = {at}.node"


def _paragraphs_sql(d: Dialect) -> str:
    """Lines with their starts, each cut from the left as long as there is more of it."""
    head = f"regexp_extract(substr(line, cur + 1, {paragraphs.MOST}), '^.*[{paragraphs.MARKS}]', 0, 's')"
    stop = f"CASE WHEN cur + {paragraphs.MOST} >= length(line) THEN length(line) WHEN length({head}) - 1 > {paragraphs.MOST // 2} THEN cur + length({head}) ELSE cur + {paragraphs.MOST} END"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM @documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(ls))) AS source, unnest(ls) AS line FROM t),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM u),
f AS (SELECT doc_id, source, base, line, 0::BIGINT AS cur, 0::BIGINT AS fragment FROM l UNION ALL SELECT doc_id, source, base, line, {stop}, fragment + 1 FROM f WHERE {stop} < length(line)),
p AS (SELECT *, substr(line, cur + 1, {stop} - cur) AS piece FROM f), q AS (SELECT *, regexp_replace(piece, '^{paragraphs.SPACE}+|{paragraphs.SPACE}+$', '', 'g') AS txt, length(piece) - length(regexp_replace(piece, '^{paragraphs.SPACE}+', '')) AS lead FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY source, fragment) - 1 AS paragraph, source, fragment, CAST(base + cur + lead AS BIGINT) AS start, CAST(base + cur + lead + length(txt) AS BIGINT) AS stop, md5(txt) AS text FROM q WHERE txt <> ''"""


def _summary_sql(d: Dialect, keys: str, more: str, join: str) -> str:
    """Sums and joined texts by ``keys`` over sentences cut anew from the paragraphs, then the ratios."""
    per = lambda a, b: f"round(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} END, 6)"
    k = ", ".join(f"t.{x.strip()}" for x in keys.split(","))
    sums = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in ("chars", "tok", "pos", "neg", "fight", "excl", "ques", "pause", "dlg"))
    ratios = {"pos_density": per("pos", "tok"), "neg_density": per("neg", "tok"), "net_density": per("(pos - neg)", "tok"), "fight_density": per("fight", "tok"), "exclaim_per_100_chars": per("excl * 100", "chars"), "question_per_100_chars": per("ques * 100", "chars"), "pause_per_100_chars": per("pause * 100", "chars"), "dialogue_ratio": per("dlg", "chars"), "avg_sent_len": per("sl", "sn"), "sent_len_std": "round(CASE WHEN sn > 0 THEN sqrt(greatest(0e0, CAST(sq AS DOUBLE) / sn - (CAST(sl AS DOUBLE) / sn) * (CAST(sl AS DOUBLE) / sn))) END, 4)", "ttr": per("len(list_distinct(words))", "len(words)")}
    return f"""WITH {d.paragraphs()}, lab AS ({CHAPTER_LABELS}), x AS (SELECT doc_id, ch, length(trim(unnest(string_split_regex(txt, '[。！？!?]+')))) AS n FROM para),
s AS (SELECT {keys}, count(*) AS sn, sum(n) AS sl, sum(n * n) AS sq FROM x WHERE n > 0 GROUP BY {keys}),
t AS (SELECT {keys}, count(*) AS n_paragraphs, {sums}, regexp_extract_all(string_agg(txt, '' ORDER BY pid), '{TOKEN}') AS words FROM para GROUP BY {keys})
SELECT {k}, n_paragraphs, chars, tok, {', '.join(f'{x} AS {n}' for n, x in ratios.items())}, {more} FROM t LEFT JOIN s USING ({keys}) {join}"""


def _book_sql(d: Dialect) -> str:
    share = lambda c, name: f"{name} AS (SELECT doc_id, string_agg(v || ':' || printf('%.4f', round(CAST(n AS DOUBLE) / total, 6)), ',' ORDER BY v) AS {name} FROM (SELECT doc_id, CAST({c} AS VARCHAR) AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM chap WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' GROUP BY doc_id, {c}) z GROUP BY doc_id)"
    base = _summary_sql(d, "doc_id", "n_chapters, pivot_rate, cliffhanger_rate, coalesce(function_share, '') AS function_share, coalesce(valence_share, '') AS valence_share", "JOIN rate USING (doc_id) LEFT JOIN function_share USING (doc_id) LEFT JOIN valence_share USING (doc_id)")
    extra = f"chap AS (SELECT DISTINCT p.doc_id, p.ch, narrative_function, pivot_moment, cliffhanger, emotional_valence FROM para p LEFT JOIN lab ON p.doc_id = lab.doc_id AND p.ch = lab.ch), rate AS (SELECT doc_id, count(*) AS n_chapters, round(avg(CAST(pivot_moment AS DOUBLE)), 6) AS pivot_rate, round(avg(CAST(cliffhanger AS DOUBLE)), 6) AS cliffhanger_rate FROM chap GROUP BY doc_id), {share('narrative_function', 'function_share')}, {share('emotional_valence', 'valence_share')}"
    return base.replace(", x AS (SELECT doc_id, ch, length", f", {extra}, x AS (SELECT doc_id, ch, length", 1)


def _statistics_sql(d: Dialect) -> str:
    """Each statistic by a query of its own over the paragraphs; places of extremes by ranks."""
    base = f"WITH {tension(d)}, r AS (SELECT p.*, CASE WHEN p.tok > 0 THEN CAST(p.pos - p.neg AS DOUBLE) / p.tok END AS net, round({SIGMOID}, 9) AS tension FROM para p JOIN z ON p.doc_id = z.doc_id AND p.pid = z.pid), s AS (SELECT doc_id, length(trim(unnest(string_split_regex(txt, '[。！？!?]+')))) AS n FROM para), w AS (SELECT doc_id, unnest(regexp_extract_all(string_agg(txt, '' ORDER BY pid), '{TOKEN}')) AS tk FROM para GROUP BY doc_id)"
    one = lambda name, value, source, where="": f"SELECT doc_id, '{name}' AS name, round(CAST({value} AS DOUBLE), 6) AS value FROM {source} {where} GROUP BY doc_id"
    parts = [one("avg_ttr", "CAST(count(DISTINCT tk) AS DOUBLE) / count(*)", "w"), one("avg_sent_len", "avg(n)", "s", "WHERE n > 0"), one("emotion_avg", "CAST(sum(pos) - sum(neg) AS DOUBLE) / sum(tok)", "r") + " HAVING sum(tok) > 0", one("lexicon_zero_hit_share", "CAST(sum(CASE WHEN pos = 0 AND neg = 0 THEN chars ELSE 0 END) AS DOUBLE) / sum(chars)", "r")]
    for x, name in (("net", "emotion"), ("tension", "rhythm")):
        parts += [one(f"{name}_{k}", f"{f}({x})", "r", f"WHERE {x} IS NOT NULL") for k, f in (("avg", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min")) if (name, k) != ("emotion", "avg")]
        parts += [f"SELECT doc_id, '{name}_{k}' AS name, CAST(ch AS DOUBLE) AS value FROM r WHERE {x} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {x} {way}, pid DESC) = 1" for k, way in (("peak_chapter_id", "DESC"), ("min_chapter_id", "ASC"))]
    return base + " " + " UNION ALL ".join(parts)


_ACTIONS_SQL = f"{FOREST}, act AS (SELECT first AS root, event_id, ch, CASE event_type WHEN 'view' THEN 'setup' WHEN 'click' THEN 'reinforce' WHEN 'purchase' THEN 'payoff' END AS action FROM ev WHERE event_type IN ('view', 'click', 'purchase')), thread AS (SELECT root, count(*) AS n_actions, arg_min(action, ch * 1000000000 + event_id) AS first_action, arg_max(action, ch * 1000000000 + event_id) AS last_action, arg_max(event_id, ch * 1000000000 + event_id) AS last_event, min(ch) AS first_chapter, max(ch) AS last_chapter, list_sort(list(DISTINCT ch)) AS chs FROM act GROUP BY root)"
_EXPECTATION_SQL = _ACTIONS_SQL + """, root AS (SELECT ev.ch AS run, ev.event_id AS root, CASE WHEN value > 40 THEN 'high' WHEN value > 20 THEN 'medium' WHEN value > 5 THEN 'low' END AS likely FROM ev JOIN @events e ON e.event_id = ev.event_id WHERE ev.event_id = first),
sc AS (SELECT run, likely, coalesce(n_actions, 1) AS hits, coalesce(last_action, 'setup') AS last FROM root LEFT JOIN thread USING (root)),
pt AS (SELECT run, likely, CASE likely WHEN 'high' THEN 0.65 WHEN 'medium' THEN 0.38 WHEN 'low' THEN 0.09 ELSE 0.33 END + CASE last WHEN 'setup' THEN -0.07 WHEN 'reinforce' THEN 0.03 ELSE 0.28 END + CASE WHEN hits >= 3 THEN 0.08 WHEN hits = 2 THEN 0.04 ELSE 0 END AS score, CASE last WHEN 'setup' THEN 0.75 WHEN 'reinforce' THEN 1.0 ELSE 1.2 END + CASE WHEN hits >= 3 THEN 0.2 WHEN hits = 2 THEN 0.1 ELSE 0 END + CASE likely WHEN 'high' THEN 0.05 WHEN 'medium' THEN 0 ELSE -0.05 END AS weight FROM sc),
expected AS (SELECT run, round(CASE WHEN count(likely) > 0 THEN CAST(sum(least(1, greatest(0, score)) * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) END, 4) AS expectation FROM pt GROUP BY run)"""


#: Nodes of the forest: whole events up to day 15; a parent counts where it is one too.
FOREST_SQL = f"WITH RECURSIVE {FOREST}, node AS (SELECT event_id, ch, nxt, nxt_ch, event_type, first, CASE WHEN parent IN (SELECT event_id FROM ev WHERE until = ch) THEN parent END AS parent FROM ev WHERE ch <= 15 AND until = ch), tree AS (SELECT event_id, event_id AS tree_id FROM node WHERE parent IS NULL UNION ALL SELECT node.event_id, tree_id FROM node JOIN tree ON node.parent = tree.event_id)"

ORACLES = {
    "foreshadow_trees": lambda d: f"WITH {_ACTIONS_SQL} SELECT root, n_actions, first_chapter, first_action, last_chapter, last_action, CASE WHEN last_action = 'payoff' THEN last_event END AS last_target, array_to_string(chs, ',') AS chapters, CASE last_action WHEN 'setup' THEN 'open' WHEN 'reinforce' THEN 'reinforced' ELSE 'likely_paid_off' END AS status, last_action <> 'payoff' AS active FROM thread",
    "foreshadow_expectation": lambda d: f"WITH {_EXPECTATION_SQL} SELECT run, expectation FROM expected",
    "api_diagnosis": lambda d: f"WITH {_EXPECTATION_SQL} SELECT root, array_to_string(chs, ',') AS chapters, CASE last_action WHEN 'setup' THEN 'open' WHEN 'reinforce' THEN 'reinforced' ELSE 'likely_paid_off' END AS status, expectation FROM thread JOIN root USING (root) JOIN expected USING (run)",
    "book_statistics": _statistics_sql,
    "chapter_summary": lambda d: _summary_sql(d, "doc_id, ch", "nullif(narrative_function, '') AS narrative_function, pivot_moment, cliffhanger, emotional_valence", "LEFT JOIN lab USING (doc_id, ch)"),
    "book_summary": _book_sql,
    "paragraph_spans": _paragraphs_sql,
    # a token's chain is followed to a root, out of the sentence, or to a token that it has met: those it met since are a cycle
    "dependency_depth": lambda d: "WITH RECURSIVE t AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS d, l_partkey % (count(*) OVER (PARTITION BY l_orderkey) + 2) AS h, l_suppkey % 3 AS r FROM @lineitem), w AS (SELECT o, d, d AS cur, [d] AS path, false AS met FROM t UNION ALL SELECT w.o, w.d, t.h, list_append(path, t.h), list_contains(path, t.h) FROM w JOIN t ON w.o = t.o AND w.cur = t.d WHERE t.h <> 0 AND NOT met), e AS (SELECT o, d, len(path) AS n, met, CASE WHEN met THEN list_position(path, cur) END AS enters FROM w QUALIFY row_number() OVER (PARTITION BY o, d ORDER BY len(path) DESC) = 1), k AS (SELECT o, d, CASE WHEN met THEN enters ELSE n - 1 END AS depth FROM e) SELECT t.o AS l_orderkey, count(*) AS n_nodes, count(CASE WHEN h = 0 THEN 1 END) AS n_roots, CAST(sum(depth) AS BIGINT) AS depth_sum, max(depth) AS depth_max, count(CASE WHEN r = 0 THEN 1 END) AS r0 FROM t JOIN k ON t.o = k.o AND t.d = k.d GROUP BY t.o",
    "durable_consumer": lambda d: ORACLES["outbox_projection"](d),
    "subscription_deltas": lambda d: "WITH p AS (SELECT *, event_id * 4 // (SELECT max(event_id) + 1 FROM @events) AS part FROM @events), c AS (SELECT user_id, max(CASE WHEN part <= 1 THEN event_id END) AS cursor FROM p GROUP BY user_id) SELECT p.user_id AS run_id, any_value(cursor) AS cursor, count(CASE WHEN part > 1 THEN 1 END) AS more, max(CASE WHEN part > 1 THEN event_id END) AS up_to FROM p JOIN c ON p.user_id = c.user_id GROUP BY p.user_id",
    "contribution_replay": lambda d: "SELECT c_mktsegment AS producer, count(*) AS rows, true AS appended, false AS appended_again, count(*) AS stored, count(DISTINCT c_name) AS entities FROM @orders JOIN @customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "alias_pairs": lambda d: f"WITH e AS ({ENTITIES}), n AS (SELECT DISTINCT name FROM e), p AS (SELECT x.name AS short_name, y.name AS long_name FROM n x JOIN n y ON length(x.name) >= 2 AND x.name <> y.name AND strpos(y.name, x.name) > 0) SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, short_name, long_name FROM p JOIN e a ON a.name = short_name JOIN e b ON b.name = long_name",
    "event_forest": lambda d: FOREST_SQL + " SELECT node.event_id, tree_id, parent AS parent_event_id, CASE WHEN parent IS NULL THEN 'root' ELSE 'main' END AS cause_role, row_number() OVER (ORDER BY ch, node.event_id) - 1 AS event_ordinal FROM node JOIN tree ON node.event_id = tree.event_id",
    "event_forest_trees": lambda d: FOREST_SQL + " SELECT tree_id, string_agg(DISTINCT ch::VARCHAR, ',') AS chapters, min(node.event_id) AS char_start, max(node.event_id) + 1 AS char_end, count(*) AS nodes FROM node JOIN tree ON node.event_id = tree.event_id GROUP BY tree_id",
    "event_forest_edges": lambda d: FOREST_SQL + " SELECT event_id AS relation_id, event_id AS source, nxt AS target FROM node WHERE event_type <> 'view' AND nxt_ch <= 15 AND nxt IN (SELECT event_id FROM node)",
    "event_forest_threads": lambda d: FOREST_SQL + ", act AS (SELECT first AS root, event_id, ch, CASE event_type WHEN 'view' THEN 'setup' WHEN 'click' THEN 'reinforce' WHEN 'purchase' THEN 'payoff' END AS action FROM ev WHERE ch <= 15 AND event_type IN ('view', 'click', 'purchase') AND first IN (SELECT event_id FROM node)), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ch DESC, event_id DESC) AS n, min(ch) OVER (PARTITION BY root) AS begun FROM act) SELECT root AS root_event_id, begun AS first_chapter, ch AS last_chapter, CASE WHEN action = 'payoff' THEN event_id END AS payoff_event_id, CASE action WHEN 'setup' THEN 'open' WHEN 'reinforce' THEN 'reinforced' ELSE 'likely_paid_off' END AS status, action <> 'payoff' AS active FROM r WHERE n = 1",
    "api_event_trees": lambda d: f"SELECT t.tree_id, chapters, nodes, status FROM (SELECT * FROM ({ORACLES['event_forest_trees'](d)}) t ORDER BY char_start, tree_id LIMIT 20) t LEFT JOIN ({ORACLES['event_forest_threads'](d)}) h ON h.root_event_id = t.tree_id",
    "hits": _hits_sql,
    # an order has one customer, so a customer's component is the customer and the customer's orders
    "components": lambda d: "SELECT DISTINCT o_custkey AS node, o_custkey AS component FROM @orders UNION ALL SELECT 1099511627776 + o_orderkey AS node, o_custkey AS component FROM @orders",
    "fuzzy_hits": lambda d: "WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+'))) AS tk FROM @documents), v AS (SELECT DISTINCT tk FROM t), n AS (SELECT tk FROM v WHERE least(levenshtein(tk, 'ersterh'), levenshtein(tk, 'token'), levenshtein(tk, 'license')) = 1) SELECT doc_id, count(*) AS fuzzy_hits FROM t JOIN n USING (tk) WHERE tk NOT IN ('ersterh', 'token', 'license') GROUP BY doc_id",
    "outbox_projection": lambda d: "SELECT user_id AS run_id, max(event_id) AS last_seq, count(*) AS messages, right(string_agg(event_type || ';', '' ORDER BY event_id), 8192) AS tail FROM @events GROUP BY user_id",
    "outbox_stream": lambda d: "SELECT user_id AS run_id, max(event_id) AS last_seq, count(*) AS messages, right(string_agg(event_type || ';', '' ORDER BY event_id), 8192) AS tail FROM @events GROUP BY user_id",
    "trailing_windows": lambda d: "SELECT event_type AS model, strftime(time_bucket(INTERVAL 10 MINUTE, ts) - step * INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M') AS start, count(*) AS turns, count(CASE WHEN value > 20 THEN 1 END) AS failures FROM @events CROSS JOIN (VALUES (0), (1), (2)) v(step) GROUP BY event_type, time_bucket(INTERVAL 10 MINUTE, ts) - step * INTERVAL 10 MINUTE",
    "component_summary": lambda d: "SELECT count(*) AS components, max(n) AS largest FROM (SELECT o_custkey, 1 + count(*) AS n FROM @orders GROUP BY o_custkey) t",
}
