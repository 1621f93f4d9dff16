"""Composites: ingestion, questions, evaluation, as plans over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import html, intent, scoring
from ..functions.constants import NAMESPACES
from ..functions.text import text
from ..models import Embed, Generate, call, call_checked, call_distinct, embed_column
from ..operators import chunking, cleaning, evaluation, rerank, retrieval, store
from ..operators import facts as facts_op
from ..tables import bound_batches, once, written
from . import answers


def ingest_texts(texts: DataFrame, embed: Embed, dims: int = 32, least: int = 30) -> DataFrame:
    """C10, C12, C16. Texts with their source columns to chunks with ids, places, vectors and score hints.

    Texts of fewer than ``least`` characters make no chunk.
    """
    places = [c for c in ("namespace", "source_type", "source_url", "source_path", "page") if c in texts.columns]
    solid = texts.where(F.length(F.trim(text("text"))) >= least)
    rows = chunking.explode_chunks(chunking.chunk_text(solid), keep=tuple(places))
    rows = rows.withColumn("embedding", embed_column(embed, "text"))
    rows = store.with_defaults(store.zero_vector_fallback(rows.withColumn("score_hint", F.lit(0.0)), dims), store.CHUNKS)
    return rows.withColumn("id", store.chunk_id())


def ingest_pages(pages: DataFrame, embed: Embed, namespace: str = "external", dims: int = 32) -> DataFrame:
    """C11, C15, POST /pipeline/external/scrape. Pages to chunks: best text, menu lines dropped, numbered sections apart."""
    p = once(bound_batches(pages).select("url", "html"), _x=html.page_texts("html")).select("url", F.col("_x.article").alias("_a"), F.col("_x.main").alias("_m"))
    p = once(p, _v=cleaning.normalize_visible_text("_m"))
    p = once(p, _c=cleaning.page_content(F.col("_a"), F.col("_m"), F.col("_v")))
    p = once(p, _t=cleaning.clean_web_text("_c"))
    rows = p.select("url", F.explode(chunking.numbered_sections("_t")).alias("text"))
    rows = rows.select(F.lit(namespace).alias("namespace"), F.lit("web_page").alias("source_type"), F.col("url").alias("source_url"), F.concat("url", F.lit("/content.txt")).alias("source_path"), F.lit(0).alias("page"), "text")
    return ingest_texts(rows, embed, dims)


def ingest_facts(chunks: DataFrame, extract: Generate, keep: tuple[str, ...] = ("namespace", "source_type", "source_path", "page")) -> DataFrame:
    """C10, G14. Facts of each document's best chunks through an extractor hook, deduplicated, with ids."""
    top = facts_op.top_fact_chunks(chunks, "source_path", "chunk_index").withColumn("_clip", facts_op.clip("text"))
    top = call_distinct(top, extract, "_clip", "answer", "_error").withColumn("answer", F.coalesce("answer", F.lit(""))).drop("_clip", "_error")
    rows = facts_op.parse_facts(top.withColumn("entity_hint", F.lit("unknown")), keep=keep)
    rows = cleaning.keep_first(rows, [*keep, F.lower("entity"), F.lower("key"), F.lower("value"), F.lower("unit"), "year"], ["ord"])
    return store.with_defaults(rows.drop("ord"), store.FACTS).withColumn("id", store.fact_id())


def with_vectors(chunks: DataFrame, embed: Embed) -> DataFrame:
    """Chunks with vectors, made once and written, where ingestion hasn't stored them."""
    return chunks if "embedding" in chunks.columns else written(chunks.withColumn("embedding", embed_column(embed, "text")))


def retrieve(chunks: DataFrame, questions: DataFrame, embed: Embed, k: int, namespaces: tuple[str, ...] | None = None) -> DataFrame:
    """C8, D1, O8. The nearest chunks of each question, ``k`` from each namespace, best first; ord is the rank. Written, as it is read several times."""
    vectors = with_vectors(chunks, embed).where("embedding IS NOT NULL")
    q = written(questions.select("qid", embed_column(embed, "question").alias("embedding")).where("embedding IS NOT NULL"))
    parts = [(F.lit(0), vectors)] if namespaces is None else [(F.lit(i), vectors.where(F.col("namespace") == n)) for i, n in enumerate(namespaces)]
    found = reduce(DataFrame.unionByName, [retrieval.vector_topk(v, q, k, ident="id").withColumn("_ns", i) for i, v in parts])
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "_ns", "rank")
    return written(found.withColumn("ord", F.row_number().over(w)).drop("_ns").join(questions, "qid"))


def facts_of(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """P3, O5. Facts of the key each question asks for, from paths that hold its preferred domain; asked: (qid, key, domain)."""
    a = asked.where("key <> ''").select("qid", F.col("key").alias("_key"), F.col("domain").alias("_domain"))
    found = retrieval.in_blocks(a, "qid", lambda block: facts.join(block, F.col("key") == F.col("_key")))
    return found.where(F.contains("source_path", "_domain")).drop("_key", "_domain")


def routed(questions: DataFrame, router: Generate | None) -> DataFrame:
    """C1. (qid, question, route, key, domain): by words, or by a model's word where no fact key settles it."""
    q = questions.select("qid", "question", intent.route("question").alias("route"), intent.fact_key("question").alias("key"), intent.preferred_domain("question").alias("domain"))
    if router is None:
        return q
    said = F.lower(F.trim(call(router, "question")))
    model = F.when(said.contains("structured"), "structured_rag").when(said.contains("semantic"), "semantic_rag").otherwise(F.col("route"))
    return q.withColumn("_said", model).withColumn("route", F.when((F.col("route") == "structured_rag") & (F.col("key") != ""), F.col("route")).otherwise(F.col("_said"))).drop("_said")


def ask(
    chunks: DataFrame,
    questions: DataFrame,
    embed: Embed,
    generate: Generate,
    k: int = 8,
    facts: DataFrame | None = None,
    raw: DataFrame | None = None,
    search: DataFrame | None = None,
    router: Generate | None = None,
    namespaces: tuple[str, ...] = NAMESPACES,
    no_search: str = "no search",
) -> DataFrame:
    """C1-C9, POST /ask. (qid, route, answer, answered_by, n_chunks, sufficient, error), a row a question.

    A question with a fact key goes to the facts (after a list, if it asks for one).
    Then, from the primary source of its reranked and expanded chunks: a numbered
    list, an article's trends, one section; else the generator with the assembled
    context, if that is sufficient or matches the one article that is asked for; else
    search results (qid, ord, title, url, content), or what there is with a note.
    ``raw``: (path, text) of whole sources; without it no article is told.
    """
    list_ = intent.requests_list("question")
    section = ~list_ & (intent.prefers_single_article("question") | intent.requests_detail("question"))
    asked = written(once(routed(questions, router), _phrases=intent.query_phrases("question")).withColumns({"_list": list_, "_section": section}))
    phrases = asked.select("qid", "_phrases")
    found = retrieve(chunks, questions.select("qid", "question"), embed, max(k, 12), namespaces)
    where_from = F.concat_ws(" ", text("source_url"), text("source_path"))
    domain = F.col("domain")
    found = retrieval.prefer(found.join(asked.select("qid", "domain"), "qid"), (domain != "") & where_from.contains(domain), "qid").drop("domain")
    first = written(rerank.rerank(found, phrases=phrases))
    stored = chunks if "score_hint" in chunks.columns else chunks.withColumn("score_hint", F.lit(0.0))
    columns = ("qid", "question", "id", "namespace", "source_type", "source_url", "source_path", "page", "chunk_index", "text", "score")
    # What comes from the source itself is scored by its hint, as it wasn't searched.
    expanded = answers.expand_primary(first, stored.withColumn("score", F.col("score_hint")), columns, phrases).join(first.select("qid", "id", F.col("rank").alias("_r")), ["qid", "id"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("_r").isNull(), "_r", "chunk_index", "id")
    ranked = written(rerank.rerank(expanded.withColumn("ord", F.row_number().over(order)).drop("_r"), phrases=phrases))

    # Only branches that some question takes are planned.
    lists, sections, keys = asked.agg(F.count_if("_list"), F.count_if("_section"), F.count_if((F.col("route") == "structured_rag") & (F.col("key") != ""))).first()
    direct = []
    if lists or sections:
        wanted = ranked.join(asked.where("_list OR _section").select("qid"), "qid", "left_semi")
        sources = written(answers.source_texts(answers.source_rows(wanted, chunks), raw))
        direct += [(1, "list", answers.numbered_list_answers(sources).select("qid", "answer"))] if lists else []
        direct += [(3, "section", answers.focus_answers(sources).select("qid", "answer"))] if sections else []
    if raw is not None:
        whole = answers.source_texts(answers.source_rows(ranked, chunks).join(raw.where("text <> ''").select(F.col("path").alias("source_path")), "source_path", "left_semi"), raw)
        direct.append((2, "article", answers.article_texts(whole)))
    if facts is not None and keys:
        keyed = asked.where("route = 'structured_rag' AND key <> ''")
        told = facts_op.facts_answer(facts_of(facts, keyed)).join(keyed.select("qid", "key"), "qid")
        after_lists = told.where("key = 'numbered_section_title'").select("qid", "answer")
        direct += [(0, "facts", told.where("key <> 'numbered_section_title'").select("qid", "answer")), (1.5, "facts", after_lists)]
    none = asked.limit(0).select("qid", F.struct(F.lit(0.0).alias("i"), F.lit("").alias("answered_by"), F.lit("").alias("answer")).alias("a"))
    tagged = reduce(DataFrame.unionByName, [none] + [d.select("qid", F.struct(F.lit(float(i)).alias("i"), F.lit(by).alias("answered_by"), "answer").alias("a")) for i, by, d in direct])
    direct_ = written(tagged.groupBy("qid").agg(F.min("a").alias("a")))

    top = ranked.where(F.col("rank") <= k)
    contexts = rerank.assemble_context(top)
    matches = F.max(intent.prefers_single_article("question") & (F.size(scoring.phrase_matches(F.col("_phrases"), "text")) > 0))
    contexts = contexts.join(top.join(phrases, "qid").groupBy("qid").agg(matches.alias("_match")), "qid")
    # Only what isn't answered yet is generated.
    open_ = asked.select("qid", "question").join(direct_.select("qid"), "qid", "left_anti")
    prompts = open_.join(contexts, "qid")
    made = written(prompts.withColumn("_c", call_checked(generate, F.concat(F.lit("Question: "), "question", F.lit("\n"), "context"))).select("qid", "n_chunks", F.col("sufficient"), (F.col("sufficient") | F.col("_match")).alias("_enough"), "_c.*"))
    generated = made.where("_enough AND error IS NULL").select("qid", F.col("output").alias("answer"), F.lit("generator").alias("answered_by"), F.lit("semantic_rag").alias("route"), "error")
    unsure = open_.join(made, "qid", "left").where("_enough IS NULL OR NOT _enough OR error IS NOT NULL")
    if search is not None:
        snippets = unsure.select("qid", "question", "error").join(rerank.snippets_text(search), "qid")
        summed = snippets.withColumn("_c", call_checked(generate, F.concat(F.lit("Question: "), "question", F.lit("\nTEXT:\n"), "snippets")))
        searched = summed.select("qid", F.coalesce("_c.output", F.concat(F.lit(C.SEARCH_WITHOUT_MODEL), "snippets")).alias("answer"), F.lit("search").alias("answered_by"), F.lit(C.SEARCH_ROUTE).alias("route"), F.coalesce("_c.error", "error").alias("error"))
        searched = written(searched)
        unsure = unsure.join(searched.select("qid"), "qid", "left_anti")
    noted = F.concat(F.trim("output"), F.lit(C.NO_SEARCH_NOTE % no_search))
    has = F.col("output").isNotNull()
    rest = unsure.select(
        "qid", F.when(has, noted).otherwise(C.NOTHING_FOUND % no_search).alias("answer"), F.when(has, "generator").otherwise("nothing").alias("answered_by"),
        F.when(has, "semantic_rag").otherwise(C.SEARCH_ROUTE).alias("route"), "error",
    )
    by_facts = F.col("a.answered_by") == "facts"
    said = direct_.select("qid", "a.answer", "a.answered_by", F.when(by_facts, "structured_rag").otherwise("semantic_rag").alias("route"), F.lit(None).cast("string").alias("error"))
    all_ = reduce(DataFrame.unionByName, [said, generated, rest] + ([searched] if search is not None else []))
    return all_.join(contexts.select("qid", "n_chunks", "sufficient"), "qid", "left").select(
        "qid", "route", "answer", "answered_by", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("sufficient", F.lit(False)).alias("sufficient"), "error"
    )


def run_eval(
    chunks: DataFrame, questions: DataFrame, embed: Embed, generate: Generate, k: int = 5, facts: DataFrame | None = None, namespace: str | None = None, **options
) -> DataFrame:
    """C14, POST /eval/run. Measures of each question (qid, question, patterns): of vector search, of facts, of the answer of ``ask`` and its route.

    ``namespace`` is the one that is searched; without it all are. ``eval_summary`` gives the means.
    """
    most = max(k, 8)
    chunks = with_vectors(chunks, embed)
    searched = chunks if namespace is None else chunks.where(F.col("namespace") == namespace)
    found = retrieve(searched, questions.select("qid", "question"), embed, most).withColumn("rank", F.col("ord"))
    semantic = evaluation.precision_recall(found, questions, k).withColumnRenamed("context_precision", "semantic_context_precision")
    none = questions.select("qid").limit(0).select("qid", F.lit(0).alias("rank"), F.lit("").alias("text"))
    if facts is None:
        held = none
    else:
        kept = facts if namespace is None else facts.where(F.col("namespace") == namespace)
        asked = questions.select("qid", intent.fact_key("question").alias("key"), F.lit("").alias("domain"))
        w = Window.partitionBy("qid").orderBy("year", "entity", "id")
        told = F.trim(F.concat_ws(" ", text("entity"), text("key"), text("value"), text("evidence_text")))
        held = facts_of(kept, asked).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "rank", told.alias("text"))
    columns = {"precision_at_k": "structured_precision_at_k", "recall_at_k": "structured_recall_at_k", "relevant_retrieved": "structured_relevant_retrieved", "total_relevant": "structured_total_relevant"}
    structured = evaluation.precision_recall(held, questions, k).drop("context_precision").withColumnsRenamed(columns)
    answered = written(ask(chunks, questions, embed, generate, most, facts=facts, **options))
    said = answered.select("qid", "answer").join(questions, "qid")
    quality = evaluation.answer_quality(said, found.select("qid", "text"))
    rows = semantic.join(structured, "qid").join(quality, "qid", "left").join(answered.select("qid", F.col("route").alias("answer_route")), "qid", "left")
    rows = rows.na.fill(0.0, ["answer_relevance", "faithfulness"]).na.fill("", ["answer_route"])
    return rows.withColumn("retrieval_delta", evaluation.retrieval_delta("precision_at_k", "structured_precision_at_k"))
