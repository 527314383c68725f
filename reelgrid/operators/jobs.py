"""Job tables: queue order, dependencies, roll-ups, publishing."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.functions.parse import nfkc
from reelgrid.functions.text import text_or_empty
from reelgrid.operators.scale import join_keys, positions, stable, top_k


def queue_order(jobs: DataFrame) -> DataFrame:
    """Position of every pending job: high priority first, then score, then age."""
    x = jobs.where(F.col("status") == "pending").withColumn("__all", F.lit(0))
    high = F.when(F.col("priority") == "high", 0).otherwise(1)
    order = [high, F.desc("score"), F.col("created_at"), F.col("id")]
    out = positions(x, ["__all"], order, "queue_pos").drop("__all")
    return out.withColumn("ahead", F.col("queue_pos") - 1)


def ready_jobs(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pending jobs with their readiness and the first blocking dependency.

    jobs: pack_id, workflow, status, depends_on, depends_on_artifacts;
    artifacts: pack_id, artifact.
    """
    pend = jobs.where(F.col("status") == "pending").select("pack_id", "workflow", "depends_on", "depends_on_artifacts")
    good = jobs.select("pack_id", F.col("workflow").alias("need"), F.col("status").isin("done", "published", "partial").alias("ok"))
    wf = pend.select("pack_id", "workflow", F.explode("depends_on").alias("need")).where(F.trim("need") != "")
    art = pend.select("pack_id", "workflow", F.explode("depends_on_artifacts").alias("need")).where(F.trim("need") != "")
    have = artifacts.select("pack_id", F.col("artifact").alias("need"), F.lit(True).alias("ok")).distinct()
    checks = join_keys(wf, good, ["pack_id", "need"]).unionByName(join_keys(art, have, ["pack_id", "need"]))
    bad = checks.groupBy("pack_id", "workflow").agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready"), F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("need"))).alias("blocked_by")
    )
    x = join_keys(pend.select("pack_id", "workflow"), bad, ["pack_id", "workflow"])
    return x.withColumn("ready", F.coalesce("ready", F.lit(True)))


def cascade_failed(jobs: DataFrame) -> DataFrame:
    """Pending jobs that depend, directly or not, on a failed one of their pack.

    jobs: pack_id, workflow, status, depends_on.  One join per level of the
    dependency chain over the newly failed jobs only.
    """
    edges = jobs.where(F.col("status") == "pending").select("pack_id", "workflow", F.explode("depends_on").alias("need"))
    edges = stable(edges.distinct())
    front = jobs.where(F.col("status") == "failed").select("pack_id", F.col("workflow").alias("need")).distinct()
    hit = None
    while True:
        new = edges.join(front, ["pack_id", "need"], "left_semi").select("pack_id", "workflow").distinct()
        if hit is not None:
            new = new.join(hit, ["pack_id", "workflow"], "left_anti")
        new = stable(new)
        if not new.limit(1).count():
            return new if hit is None else hit
        hit = new if hit is None else stable(hit.unionByName(new))
        front = new.withColumnRenamed("workflow", "need")


def upstream_of(tasks: DataFrame, chain: Sequence[str], default: str = "source") -> DataFrame:
    """Last selected step before each chain step (``tasks``: job_id, step)."""
    order = F.lit(None).cast("int")
    for i, s in enumerate(chain):
        order = F.when(F.col("step") == s, i).otherwise(order)
    x = tasks.select("job_id", "step").distinct().withColumn("__o", order).where("__o is not null")
    # At most one row per chain step and job: the window is bounded by the chain.
    w = Window.partitionBy("job_id").orderBy("__o")
    return x.select("job_id", "step", F.coalesce(F.lag("step").over(w), F.lit(default)).alias("upstream"))


def latest_steps(events: DataFrame) -> DataFrame:
    """Last event per job and step."""
    return events.groupBy("job_id", "step_key").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("event_id").alias("event_id")
    )


def parent_status(counts: dict[str, Column], done: Column) -> Column:
    """Status of a job from the counts of its steps by status."""
    clean = (counts["failed"] == 0) & (counts["partial"] == 0)
    return (
        F.when(counts["running"] > 0, "processing").when(counts["queued"] > 0, None).when(clean, "done")
        .when((done == 0) & (counts["failed"] > 0), "failed").otherwise("partial")
    )


def rollup_jobs(steps: DataFrame) -> DataFrame:
    """Step counts and the parent status: processing, queued, done, failed or partial."""
    s = F.col("status")
    x = steps.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s.isin("done", "skipped")).alias("done"),
        *[F.count_if(s == v).alias(f"__{v}") for v in ["running", "queued", "failed", "partial"]],
    )
    status = parent_status({v: F.col(f"__{v}") for v in ["running", "queued", "failed", "partial"]}, F.col("done"))
    return x.select("job_id", "total", "done", F.concat_ws("/", "done", "total").alias("label"), status.alias("status"))


ACTIVITY = ["processing", "pending", "failed", "partial", "done", "published", "cancelled"]


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def video_status(jobs: DataFrame, order: Sequence[str] = ACTIVITY) -> DataFrame:
    """Most active status per video."""
    rank = F.lit(len(order))
    for i, s in enumerate(order):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    return jobs.groupBy("platform", "video_id").agg(F.min_by("status", F.struct(rank.alias("r"), F.col("status"))).alias("status"))


def task_stats(tasks: DataFrame, terminal: Sequence[str] = ("done", "failed", "cancelled")) -> DataFrame:
    """Success rate, steps and token totals over agent tasks."""
    end = F.col("status").isin(list(terminal))
    n = F.count_if(end)
    return tasks.agg(
        F.count(F.lit(1)).alias("total"), n.alias("terminal"),
        F.when(n > 0, F.bround(F.count_if(F.col("status") == "done") / n, 3)).alias("success_rate"),
        F.bround(F.avg(F.when(end, F.col("steps"))), 1).alias("avg_steps"), F.sum("tokens").alias("tokens"),
    )


def recent_failures(tasks: DataFrame, k: int = 5, terminal: Sequence[str] = ("done", "failed", "cancelled")) -> DataFrame:
    return tasks.where(F.col("status").isin(list(terminal)) & (F.col("status") != "done")).orderBy(F.desc("task_id")).limit(k)


def unique_slugs(articles: DataFrame) -> DataFrame:
    """Number repeated slugs of a topic in id order: slug, slug-2, slug-3, ...

    A repeat takes the smallest number that no row of the topic has yet; this
    is repeated until no made-up slug collides with another row's.
    """
    x = articles.select("topic_id", "id", "slug", F.col("slug").alias("final"))
    while True:
        dup = x.groupBy("topic_id", "final").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__first")).where("__n > 1")
        dup = stable(dup)
        if not dup.limit(1).count():
            return x
        m = join_keys(x, dup, ["topic_id", "final"])
        moving = m.where(F.col("__first").isNotNull() & (F.col("id") != F.col("__first")))
        number = F.expr("try_cast(regexp_extract(final, '-([1-9][0-9]{0,17})$', 1) as bigint)")
        base = x.withColumn("__u", number).where(F.col("__u") >= 2).select("topic_id", F.expr("left(final, length(final) - length(cast(__u as string)) - 1)").alias("slug"), "__u").distinct()
        # The i-th number in use has __u - 1 - i free ones below it.  Ordered with the
        # movers by that count, the row at position p takes the number p + 1.
        base = base.join(moving.select("topic_id", "slug").distinct(), ["topic_id", "slug"], "left_semi")
        used = positions(base, ["topic_id", "slug"], [F.col("__u")], "__i")
        none = F.lit(None).cast(dict(x.dtypes)["id"])
        line = positions(moving, ["topic_id", "slug"], [F.col("id")], "__v").select("topic_id", "slug", "id", "__v", F.lit(0).alias("__kind"), F.col("__v").alias("__tie")).unionByName(
            used.select("topic_id", "slug", none.alias("id"), (F.col("__u") - 1 - F.col("__i")).alias("__v"), F.lit(1).alias("__kind"), F.col("__u").alias("__tie"))
        )
        placed = positions(line, ["topic_id", "slug"], [F.col("__v"), F.col("__kind"), F.col("__tie")], "__p").where("__kind = 0")
        moved = placed.withColumn("final", F.concat("slug", F.lit("-"), (F.col("__p") + 1).cast("string")))
        stay = m.where(F.col("__first").isNull() | (F.col("id") == F.col("__first")))
        x = stable(stay.select("topic_id", "id", "slug", "final").unionByName(moved.select("topic_id", "id", "slug", "final")))


def upsert_links(links: DataFrame, jobs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Mirror job fields into links; ``op`` tells insert, update or none; created_at stays."""
    j = jobs.select("platform", "video_id", F.col("updated_at").alias("__now"), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__j"))
    l = links.select("*", F.lit(True).alias("__l"))
    x = l.join(j, ["platform", "video_id"], "full")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    op = F.when(F.col("__j").isNull(), "none").when(F.col("__l").isNull(), "insert").when(same, "none").otherwise("update")
    x = x.withColumn("op", op)
    cols = [F.when(F.col("op") == "none", F.col(f)).otherwise(F.col(f"__{f}")).alias(f) for f in fields]
    return x.select(
        "platform", "video_id", *cols, F.when(F.col("op") == "insert", F.col("__now")).otherwise(F.col("created_at")).alias("created_at"), "op"
    )


def feed_rows(articles: DataFrame, needle: str = "", free_points: int = 3) -> DataFrame:
    """Search text of an article and its free points; optional substring filter.

    articles: id, title, summary, author, points array<string>.
    """
    text = F.lower(nfkc(F.concat_ws(" ", "title", "summary", "author", F.array_join(F.coalesce("points", F.array().cast("array<string>")), " "))))
    x = articles.select("id", text.alias("haystack"), F.slice("points", 1, free_points).alias("free_points"), (F.size("points") > free_points).alias("locked"))
    return x.where(F.contains("haystack", F.lit(unicodedata.normalize("NFKC", needle).lower()))) if needle else x


def audit_articles(articles: DataFrame, languages: int) -> DataFrame:
    """Language and cue completeness per article: id, langs, cues, clock, severity."""
    sev = F.when(F.col("cues") == 0, "error").when((F.col("langs") < languages) | (F.col("clock") != "source"), "warn").otherwise("ok")
    return articles.select("id", "langs", "cues", "clock", sev.alias("severity"))


def decide_frames(df: DataFrame, visual_topics: Sequence[str], action: Sequence[str], talk: Sequence[str], seconds: float = 4.0, low: float = 2.0, high: float = 6.0) -> DataFrame:
    """Picture decision per note: topic gate, marker counts, clamped length.

    df: id, topic_id, text, has_video.
    """
    low_text = F.lower(text_or_empty("text"))

    def hits(words: Sequence[str]):
        n = F.lit(0)
        for w in words:
            n = n + low_text.contains(w.lower()).cast("int")
        return n

    a, t = hits(action), hits(talk)
    media = (
        F.when(~F.col("has_video") | ~F.col("topic_id").isin(list(visual_topics)), "none")
        .when((a >= 1) & (a >= t), "gif").when(t > a, "none").when((a == 0) & (t == 0), "jpg").otherwise("gif")
    )
    dur = max(low, min(high, seconds))
    return df.select("id", media.alias("media"), (media != "none").alias("enabled"), F.lit(dur).alias("seconds"))


def latest_jobs(jobs: DataFrame, n: int) -> DataFrame:
    return top_k(jobs.withColumn("__all", F.lit(0)), ["__all"], [F.desc("updated_at"), F.desc("id")], n).drop("__all", "rank")
