"""Search: lexical and dense scores, fusion, rerank, chunks, top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions import fixed_values as fv
from reelgrid.functions import tags as tg
from reelgrid.functions.text import (
    as_col,
    field_token_weight,
    path_tail,
    text_or_empty,
    tokens,
)
from reelgrid.operators.blocks import block_products, by_bytes, unit_rows
from reelgrid.operators.containment import containments, without
from reelgrid.operators.lexical import spread_out, scan_best, scan_scores
from reelgrid.operators.scale import CHUNK_ROWS, join_keys, positions, running, stable, top_k

#: Queries that meet a piece of stored vectors at once where every pair becomes a row.
SCORED_QUERIES = 64


def catalog_fields(m: DataFrame) -> dict[str, Column]:
    """Searchable fields of a catalog row as text."""
    return {
        "name": text_or_empty("name"),
        "tags": tg.tags_to_csv("tags"),
        "description": text_or_empty("description"),
        "rel_path": path_tail("rel_path"),
    }


def query_tokens(queries: DataFrame) -> DataFrame:
    t = queries.select("qid", tokens("query").alias("t"))
    big = F.size(F.filter("t", lambda x: x.startswith("b:")))
    return t.select("qid", big.alias("q_bigrams"), F.explode("t").alias("qtok"))


def lexical_scores(
    queries: DataFrame,
    docs: DataFrame,
    fields: dict[str, Column] | None = None,
    sidecars: DataFrame | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Weighted token overlap per (qid, id); only positive scores are returned.

    Per field: the summed weights of shared tokens, or, when no token is
    shared, 0.6 per long query word found inside a longer word.  Sidecar
    channels count 0.35 and need two shared bigrams when the query has two.
    """
    fields = catalog_fields(docs) if fields is None else fields
    weights = fv.FIELD_WEIGHTS if weights is None else weights
    return scan_scores(queries, docs, fields, weights, fv.CHANNEL_WEIGHT, sidecars)


def search_rank(scores: DataFrame, m: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query; equal scores newest first, then by id."""
    x = scores.join(m.select("id", "created_at"), "id")
    return top_k(x, ["qid"], [F.desc(F.round("score", 9)), F.desc("created_at"), F.col("id")], k)


def lexical_top(queries: DataFrame, m: DataFrame, k: int, favorites: DataFrame | None = None) -> DataFrame:
    """``search_rank`` of the lexical scores of a catalog (its ids are unique), without passing on
    the other scores: qid, id, score, rank.  With ``favorites`` (mid), whose assets come first, also favorite."""
    from reelgrid.operators import catalog as cat

    rows = m if favorites is None else cat.flag_favorites(m, favorites)
    newest = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 63)))
    best = scan_best(queries, rows, catalog_fields(m), fv.FIELD_WEIGHTS, fv.CHANNEL_WEIGHT, k, [newest], None if favorites is None else F.col("favorite").cast("int"))
    x = top_k(best, ["qid"], [F.desc("boost"), F.desc(F.round("score", 9)), F.desc("tie0"), F.col("id")], k)
    flag = [] if favorites is None else [(F.col("boost") > 0).alias("favorite")]
    return x.select("qid", "id", *flag, "score", "rank")


# --- vectors -----------------------------------------------------------------------


def mean_vector(store: DataFrame) -> np.ndarray:
    """Corpus mean, one partial aggregate per dimension."""
    cells = store.select(F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    rows = cells.groupBy("pos").agg(F.avg("x").alias("x")).orderBy("pos").collect()
    return np.array([r["x"] for r in rows])


def _cosines(store: pd.DataFrame, queries: pd.DataFrame, centre) -> np.ndarray:
    """Stored vectors by query vectors."""
    rows = lambda c: unit_rows(np.stack(c.to_numpy()).astype("float64") - centre)
    return rows(store["vec"]) @ rows(queries["qvec"]).T


def score_vectors(queries: DataFrame, store: DataFrame, mean: np.ndarray | None = None, keep: Sequence[str] = ("mid",)) -> DataFrame:
    """Cosine of every stored vector with every query vector, block by block."""
    centre = 0.0 if mean is None else mean
    names = list(keep)
    schema = T.StructType([*[store.schema[c] for c in names], queries.schema["qid"], T.StructField("cos", T.DoubleType())])

    def run(s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if s.empty or q.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        cos = _cosines(s, q, centre)
        out = s[names].iloc[np.repeat(np.arange(len(s)), len(q))].reset_index(drop=True)
        return out.assign(qid=np.tile(q["qid"].to_numpy(), len(s)), cos=cos.ravel())

    return block_products(store.select(*names, "vec"), queries.select("qid", "qvec"), names[0], "qid", run, schema, right_rows=SCORED_QUERIES)


def _best_vectors(queries: DataFrame, store: DataFrame, k: int, least: float) -> DataFrame:
    """qid, mid, cos: what can be among the best ``k`` assets of a query, per block."""
    schema = T.StructType([queries.schema["qid"], store.schema["mid"], T.StructField("cos", T.DoubleType())])

    def run(s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if not s.empty and not q.empty:
            cos = _cosines(s, q, 0.0)
            for j, qid in enumerate(q["qid"]):
                own = pd.Series(cos[:, j], index=s["mid"].to_numpy())
                own = own[own >= least].groupby(level=0).max()
                if len(own) > k:  # scores are rounded later, so near ties stay
                    own = own[own >= own.nlargest(k).iloc[-1] - 1e-3]
                parts.append(pd.DataFrame({"qid": qid, "mid": own.index, "cos": own.to_numpy()}))
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema})

    return block_products(store.select("mid", "vec"), queries.select("qid", "qvec"), "mid", "qid", run, schema)


def dense_scores(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Cosine on mean-centred, re-normalised vectors: qid, id, cos."""
    return score_vectors(queries, store, mean_vector(store)).select("qid", F.col("mid").alias("id"), "cos")


def vector_topk(queries: DataFrame, store: DataFrame, k: int, min_score: float = 0.15, frames: DataFrame | None = None) -> DataFrame:
    """Top ``k`` assets by cosine; a frame channel counts with its best frame."""
    hits = _best_vectors(queries, store, k, min_score)
    if frames is not None:
        hits = hits.unionByName(_best_vectors(queries, frames, k, min_score))
    best = hits.groupBy("qid", "mid").agg(F.max("cos").alias("cos")).where(F.col("cos") >= min_score)
    best = best.withColumn("score", F.bround("cos", 4))
    return top_k(best, ["qid"], [F.desc("score"), F.col("mid")], k).drop("cos")


def rrf(lexical: DataFrame, dense: DataFrame, base: DataFrame, min_cos: float = fv.MIN_DENSE_COS) -> DataFrame:
    """Reciprocal-rank fusion of kept rows: dense above ``min_cos`` or a lexical hit.

    ``base``: id, base_pos (1-based newest-first position of every row).  Rows
    without lexical hit rank after the hits in base order, as a stable sort of
    zero scores would put them.
    """
    d = dense.join(base, "id")
    d = positions(d, ["qid"], [F.desc("cos"), F.col("base_pos")], "dense_rank")
    d = d.select("qid", "id", "cos", (F.col("dense_rank") - 1).alias("dense_rank"))
    hits = lexical.join(base, "id")
    hits = positions(hits, ["qid"], [F.desc(F.round("score", 9)), F.col("base_pos")], "lex_rank")
    hits = hits.select("qid", "id", "score", (F.col("lex_rank") - 1).alias("lex_rank"))
    both = join_keys(hits.select("qid", "id", "score", "lex_rank"), d, ["qid", "id"], "left").unionByName(
        d.join(hits.select("qid", "id"), ["qid", "id"], "left_anti").select(
            "qid", "id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("lex_rank"), "cos", "dense_rank"
        )
    )
    kept = both.where((F.coalesce("cos", F.lit(-1.0)) >= min_cos) | F.col("lex_rank").isNotNull()).join(base, "id")
    total = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    kept = join_keys(kept, total, ["qid"]).withColumn("__chunk", F.floor(F.col("base_pos") / CHUNK_ROWS))
    kept = running(
        kept, ["qid"], "__chunk", [F.col("base_pos")],
        {"hits_before": ("sum", F.col("lex_rank").isNotNull().cast("long"))}, exclusive=True,
    )
    zero_rank = F.coalesce("n_hits", F.lit(0)) + F.col("base_pos") - 1 - F.coalesce("hits_before", F.lit(0))
    lex = F.coalesce(F.col("lex_rank"), zero_rank)
    fused = fv.RRF_LEXICAL_WEIGHT / (fv.RRF_K + lex) + 1.0 / (fv.RRF_K + F.coalesce("dense_rank", F.lit(fv.RRF_MISSING_RANK)))
    return kept.select("qid", "id", "base_pos", lex.alias("lex_rank"), "dense_rank", "cos", fused.alias("fused"))


def base_positions(m: DataFrame) -> DataFrame:
    """Newest-first position of every row."""
    x = m.select("id", "created_at").withColumn("__all", F.lit(0))
    return positions(x, ["__all"], [F.desc("created_at"), F.col("id")], "base_pos").select("id", "base_pos")


def rerank(kept: DataFrame, queries: DataFrame, docs: DataFrame, n: int = fv.RERANK_TOP) -> DataFrame:
    """Second stage: the first ``n`` kept rows in base order are ordered by token
    weight in their text (``docs``: id, text), the rest follow unchanged."""
    pos = positions(kept, ["qid"], [F.col("base_pos")], "kept_pos")
    top = pos.where(F.col("kept_pos") <= n)
    qt = query_tokens(queries).select("qid", "qtok")
    words = top.select("qid", "id").join(docs.select("id", F.explode(tokens("text")).alias("qtok")), "id").join(qt, ["qid", "qtok"])
    scored = words.groupBy("qid", "id").agg(F.sum(field_token_weight(F.col("qtok"))).alias("rscore"))
    x = join_keys(pos, scored, ["qid", "id"]).withColumn("rscore", F.coalesce("rscore", F.lit(0.0)))
    ordered = top_k(x.where(F.col("kept_pos") <= n), ["qid"], [F.desc("rscore"), F.col("kept_pos")], n, "pos")
    rest = x.where(F.col("kept_pos") > n).withColumn("pos", F.col("kept_pos"))
    return ordered.withColumn("pos", F.col("pos").cast("long")).unionByName(rest)


def append_hits(ranked: DataFrame, extra: DataFrame) -> DataFrame:
    """Append document body hits (qid, id, kind, name, rank) behind a ranked list (qid, id, rank)."""
    good = extra.where((F.col("kind") == "docs") & ~F.col("name").rlike(r"(?i)(_raw|_progress|_meta|_debug)\.(json|jsonl|txt|log)$"))
    good = good.join(ranked.select("qid", "id"), ["qid", "id"], "left_anti")
    size = ranked.groupBy("qid").agg(F.max("rank").alias("__n"))
    added = join_keys(good.select("qid", "id", "rank"), size, ["qid"]).select(
        "qid", "id", (F.col("rank") + F.coalesce("__n", F.lit(0))).alias("rank"), F.lit("body").alias("via")
    )
    return ranked.select("qid", "id", "rank", F.lit("rank").alias("via")).unionByName(added)


def append_image_hits(queries: DataFrame, lexical: DataFrame, matches: DataFrame, floor: float = 0.11, gap: float = 0.01, kind: str = "") -> DataFrame:
    """Image hits that may join a query's result: only for text intent with under
    three lexical hits, a clear winner, and scores within ``gap`` of it.

    queries: qid, intent; matches: qid, id, score.
    """
    if kind and kind not in ("images", "videos"):
        return matches.limit(0)
    # A query that counts has two lexical hits at most, so the least and the greatest id are all of them.
    few = lexical.groupBy("qid").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__least"), F.max("id").alias("__greatest"))
    q = queries.where(~F.col("intent").isin("id", "speech")).select("qid").distinct().join(few, "qid", "left").where("coalesce(__n, 0) < 3")
    top = top_k(matches, ["qid"], [F.desc("score"), F.col("id")], 2, "__r")
    head = top.groupBy("qid").agg(F.max("score").alias("__top"), F.min("score").alias("__second"), F.count(F.lit(1)).alias("__m"))
    head = head.where((F.col("__m") >= 2) & (F.col("__top") >= floor) & ((F.col("__top") - F.col("__second")) >= gap))
    x = matches.join(head, "qid").where(F.col("score") >= F.col("__top") - gap).join(q, "qid")
    known = (F.col("id") == F.col("__least")) | (F.col("id") == F.col("__greatest"))
    return x.where(~F.coalesce(known, F.lit(False))).select("qid", "id", "score")


# --- chunks ---------------------------------------------------------------------------


def chunk_paragraphs(text: str | Column, size: int = 140, overlap: int = 30) -> Column:
    """Paragraphs packed to ``size`` characters; longer ones cut at sentence ends,
    longer sentences into overlapping windows."""
    t = text_or_empty(text)
    paras = F.filter(F.transform(F.split(t, r"\n+"), lambda s: F.trim(s)), lambda p: p != "")
    step = max(1, size - overlap)

    def windows(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(p) - 1, F.lit(step))
        return F.transform(starts, lambda i: F.substr(p, i + 1, F.lit(size)))

    def pieces(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, "(?<=[。！？!?；;])"), lambda s: F.trim(s)), lambda s: s != "")
        return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(windows(s))))

    def flushed(acc: Column) -> Column:
        return F.when(acc["buf"] != "", F.array_append(acc["done"], acc["buf"])).otherwise(acc["done"])

    def step_fn(acc: Column, p: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(p) <= size
        grown = F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit("\n"), p))
        added = F.when(F.length(p) <= size, F.array(p)).otherwise(pieces(p))
        return F.when(fits, F.struct(acc["done"].alias("done"), grown.alias("buf"))).otherwise(
            F.struct(F.concat(flushed(acc), added).alias("done"), F.lit("").alias("buf"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    return F.aggregate(paras, start, step_fn, flushed)


def chunk_fixed(text: str | Column, size: int = 800, overlap: int = 120) -> Column:
    """Overlapping windows; the last one ends with the text."""
    t = F.trim(text_or_empty(text))
    last = F.greatest(F.ceil((F.length(t) - size) / (size - overlap)), F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last * (size - overlap), F.lit(size - overlap))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.substr(t, i + 1, F.lit(size)))
    )


def chunk_lines(text: str | Column, max_chars: int = 5500) -> Column:
    """Whole lines packed until the next one would pass ``max_chars``."""
    t = text_or_empty(text)
    lines = F.split(F.regexp_replace(t, r"\r?\n$", ""), r"\r?\n")

    def step_fn(acc: Column, line: Column) -> Column:
        over = (acc["size"] + F.length(line) > max_chars) & (acc["n"] > 0)
        joined = F.when(acc["n"] == 0, line).otherwise(F.concat(acc["buf"], F.lit("\n"), line))
        return F.when(
            over,
            F.struct(
                F.array_append(acc["done"], acc["buf"]).alias("done"), line.alias("buf"), F.length(line).alias("size"), F.lit(1).alias("n")
            ),
        ).otherwise(
            F.struct(acc["done"].alias("done"), joined.alias("buf"), (acc["size"] + F.length(line) + 1).alias("size"), (acc["n"] + 1).alias("n"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("size"), F.lit(0).alias("n"))
    return F.aggregate(lines, start, step_fn, lambda a: F.array_append(a["done"], a["buf"]))


def chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    return docs.select("id", F.posexplode(chunks).alias("chunk", "text"))


def chunk_search(queries: DataFrame, docs: DataFrame, k: int = 10, text: str = "description") -> DataFrame:
    """Best chunk score per document, top ``k`` documents per query."""
    chunks = chunk_rows(spread_out(docs.select("id", text)), chunk_paragraphs(text))
    scored = scan_best(queries, chunks, {"description": F.col("text")}, fv.FIELD_WEIGHTS, fv.CHANNEL_WEIGHT, k)
    best = scored.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], [F.desc(F.round("score", 9)), F.col("id")], k)


# --- composition -----------------------------------------------------------------------


def locate_hits(queries: DataFrame, lines: DataFrame, scenes: DataFrame) -> DataFrame:
    """First timed line of an asset that shares a token with the query, speech
    before picture, with the scene that holds it.

    lines: id, channel (asr/visual), line_no, text, t_ms (null when untimed);
    scenes: id, start_ms, end_ms.  Single CJK characters do not match.
    """
    qt = query_tokens(queries).where(~F.col("qtok").startswith("c:")).select("qid", F.col("qtok").alias("token"))
    timed = lines.where("t_ms is not null").select("id", "channel", "line_no", "t_ms", F.explode(tokens("text")).alias("token"))
    hit = timed.join(qt, "token")
    order = F.struct(F.when(F.col("channel") == "asr", 0).otherwise(1).alias("c"), "line_no")
    best = hit.groupBy("qid", "id").agg(F.min_by(F.struct("channel", "t_ms", "line_no"), order).alias("b"))
    best = best.select("qid", "id", "b.channel", "b.t_ms", "b.line_no")
    return scene_of(best, scenes)


def scene_of(hits: DataFrame, scenes: DataFrame, tolerance_ms: int = 50, bin_ms: int = 60_000) -> DataFrame:
    """Scene containing ``t_ms`` (ends are inclusive within a tolerance); the first wins."""
    bins = F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") + tolerance_ms) / bin_ms)))
    s = scenes.select("id", F.col("start_ms").alias("scene_start_ms"), F.col("end_ms").alias("scene_end_ms"), bins.alias("__bin"))
    h = hits.withColumn("__bin", F.floor(F.col("t_ms") / bin_ms))
    cond = (
        (F.col("h.id") == F.col("s.id")) & (F.col("h.__bin") == F.col("s.__bin"))
        & (F.col("t_ms") >= F.col("scene_start_ms")) & (F.col("t_ms") <= F.col("scene_end_ms") + tolerance_ms)
    )
    pairs = h.alias("h").join(s.alias("s"), cond, "left").select(*[F.col(f"h.{c}") for c in hits.columns], "scene_start_ms", "scene_end_ms")
    first = pairs.groupBy(*hits.columns).agg(F.min(F.struct("scene_start_ms", "scene_end_ms")).alias("s"))
    return first.select(*hits.columns, "s.scene_start_ms", "s.scene_end_ms")


def search(
    queries: DataFrame,
    m: DataFrame,
    synonyms: DataFrame,
    favorites: DataFrame,
    sidecars: DataFrame | None = None,
    kind: str = "",
    tag: str = "",
    form: str = "",
    topic: str = "",
    usage: str = "",
    offset: int = 0,
    limit: int = 50,
) -> DataFrame:
    """Expand, score, filter by facets, favourites first, page; per query."""
    from reelgrid.operators import catalog as cat

    full = cat.expand_query(queries, synonyms).select("qid", F.col("expanded").alias("query"))
    rows = cat.facet_filter(cat.filter_catalog(m, kind, tag), form, topic, usage)
    side = None if sidecars is None else sidecars.join(rows.select("id"), "id", "left_semi")
    if side is None:
        return lexical_top(full, rows, offset + limit, favorites).where(F.col("rank") > offset)
    scores = lexical_scores(full, rows, sidecars=side)
    x = cat.flag_favorites(scores.join(rows.select("id", "created_at"), "id"), favorites)
    order = [F.desc("favorite"), F.desc(F.round("score", 9)), F.desc("created_at"), F.col("id")]
    page = top_k(x, ["qid"], order, offset + limit)
    return page.where(F.col("rank") > offset).drop("created_at")


def assemble(queries: DataFrame, ranked: DataFrame, m: DataFrame, limit: int, scope: str = "all") -> DataFrame:
    """Union of ranked sub-query hits: first hit of an id wins, dead or
    out-of-scope ids drop, ``limit`` per goal.

    queries: goal, qid, ord; ranked: qid, id, rank.
    """
    x = ranked.join(queries, "qid")
    first = x.groupBy("goal", "id").agg(F.min(F.struct("ord", "rank")).alias("o"))
    alive = m.select("id", "tags")
    if scope == "master":
        alive = alive.where(F.contains(tg.tags_to_csv("tags"), F.lit("role:master")))
    if scope == "clips":
        alive = alive.where(F.contains(tg.tags_to_csv("tags"), F.lit("role:clip")))
    kept = first.join(alive.select("id"), "id", "left_semi")
    return top_k(kept, ["goal"], [F.col("o"), F.col("id")], limit, "pos").select("goal", "pos", "id")


def vetoes(feedback: DataFrame) -> DataFrame:
    """Phrases of rejected feedback rows, from both query fields: phrase."""
    rows = feedback.where(~F.coalesce("accepted", F.lit(True)))
    both = rows.select(F.explode(F.array(F.trim(text_or_empty("query")), F.trim(text_or_empty("proposed_query")))).alias("phrase"))
    return both.where("phrase <> ''").distinct()


def drop_vetoed(queries: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Queries that contain, or are contained in, a vetoed phrase are dropped.

    ``vetoes``: phrase.
    """
    q = F.trim(text_or_empty("query"))
    phrases = stable(vetoes.select("phrase").where("phrase <> ''").distinct())
    kept = without(queries.withColumn("__q", q), phrases, "__q").drop("__q")
    # Only a query no longer than the longest phrase can be part of one.
    longest = phrases.agg(F.max(F.length("phrase"))).first()[0] or 0
    asked = queries.select(q.alias("q")).where((F.col("q") != "") & (F.length("q") <= longest)).distinct()
    shorter = containments(phrases, asked, "phrase", "q").select("q").distinct()
    return kept.join(shorter, q == F.col("q"), "left_anti")


def entity_search(index: DataFrame, terms: str | Sequence[str], op: str = "and", aliases: DataFrame | None = None) -> DataFrame:
    """Ids that carry all (``and``) or any (``or``) of the entities named, and how many.

    ``terms`` is one text or several; blanks, commas, plus signs and slashes divide
    them.  A term that is no entity is looked up in ``aliases`` (alias, entity), such as
    names in another language; one that is neither is left out.
    """
    text = terms if isinstance(terms, str) else " ".join(terms)
    named = index.sparkSession.range(1).select(F.explode(F.array_distinct(F.split(F.lower(F.lit(text)), r"[\s,+/]+"))).alias("term")).where("term <> ''")
    entities = named.join(index.select(F.col("entity").alias("term")), "term", "left_semi").select(F.col("term").alias("entity"))
    if aliases is not None:
        other = named.join(entities, F.col("term") == F.col("entity"), "left_anti")
        entities = entities.unionByName(other.join(aliases.select(F.lower("alias").alias("term"), "entity"), "term").select("entity")).distinct()
    entities = stable(entities)  # no more than there are terms
    hit = index.join(entities, "entity").groupBy("id").agg(F.countDistinct("entity").alias("n"))
    return hit if op != "and" else hit.join(entities.agg(F.count(F.lit(1)).alias("n")), "n", "left_semi")


def doc_text(m: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(id, text, sig): the text an embedding is computed from and its signature."""
    from reelgrid.operators.tagging import ext_of, stem_of

    ext = F.regexp_replace(ext_of(F.col("name")), r"^\.", "")
    name = F.concat_ws(" ", F.regexp_replace(stem_of(F.col("name")), r"[_\-.]+", " "), F.when(ext != "", ext))
    path = F.when(text_or_empty("external_path") != "", F.col("external_path")).otherwise(text_or_empty("rel_path"))
    folder = F.filter(F.split(F.regexp_replace(F.translate(path, "\\", "/"), "/?[^/]*$", ""), "/"), lambda d: d != "")
    tail = F.slice(folder, F.greatest(F.size(folder) - 3, F.lit(1)), 4)
    stage = F.regexp_replace(F.array_join(tail, " "), r"[_\-.]+", " ")
    tags = F.array_join(F.filter(tg.tags_of("tags"), lambda t: t != "sp"), " ")
    x = m
    side = []
    if channels is not None:
        wide = channels.groupBy("id").pivot("channel", ["ocr", "visual", "asr", "autotags"]).agg(F.first("text"))
        x = m.join(wide, "id", "left")
        side = [F.col(c) for c in ["ocr", "visual", "asr", "autotags"]]

    def full(c: Column) -> Column:
        return F.when(c != "", c)

    parts = [name, tags, F.col("description"), *side, F.col("kind"), stage]
    text = F.concat_ws(" | ", *[full(p) for p in parts])
    return x.select("id", text.alias("text"), F.substring(F.sha1(text), 1, 16).alias("sig"))


def stale_vectors(texts: DataFrame, emb: DataFrame, model: str) -> DataFrame:
    """Rows whose vector is missing, from another model or of an older text."""
    have = emb.where(F.col("model") == model).select(F.col("mid").alias("id"), "sig")
    return texts.join(have, ["id", "sig"], "left_anti")


def embed(texts: DataFrame, fn: Callable[[list[str]], Sequence[Sequence[float]]], model: str) -> DataFrame:
    """Vectors from a caller-supplied function, a few megabytes of texts per call."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float32())
        for batch in batches:
            parts = [pa.array([None if v is None else np.asarray(v, "float32") for v in fn(batch.slice(a, b - a).to_pylist())], kind) for a, b in by_bytes(batch)]
            yield pa.concat_arrays([pa.array([], kind), *parts])

    v = texts.select(F.col("id").alias("mid"), F.lit(model).alias("model"), "sig", run("text").alias("vec"))
    return v.withColumn("dim", F.size("vec"))


def hashed_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Offline default for ``embed``: bag of words hashed to ``dim`` cells."""
    import re
    import zlib

    out = np.zeros((len(texts), dim), dtype="float32")
    for i, t in enumerate(texts):
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            out[i, zlib.crc32(w.encode()) % dim] += 1.0
    return out.tolist()


def support_tier(score: str | Column, low: float = 0.6, high: float = 0.9) -> Column:
    """strong, partial or unsupported; null stays null."""
    s = as_col(score)
    return F.when(s >= high, "strong").when(s >= low, "partial").when(s.isNotNull(), "unsupported")


def arbiter_tier(score: str | Column, low: float = 0.6, high: float = 0.9) -> Column:
    s = as_col(score)
    return F.when(s >= high, "pass").when(s >= low, "partial").otherwise("fail")
