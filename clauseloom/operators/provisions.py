"""Provision lookup: citable units, corpus weights, scoring, verdicts and citations.

A batch of cases is one job: units are turned into postings, cases into terms, and the two are joined on the term, so
that work grows with the matches and not with cases times units.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .markdown import row_sentences

# ---- codes and terms


def resolve_codes(requests: DataFrame, codes: DataFrame, required: bool = False) -> DataFrame:
    """Requests (code) with descriptor, system and synonyms of their code. With ``required`` a code that is missing, or
    has a blank descriptor, raises when the row is read."""
    out = requests.withColumn("code", T.normalize_code("code")).join(codes.select("code", "descriptor", "system", "synonyms"), "code", "left")
    if required:
        bad = F.coalesce(F.trim("descriptor"), F.lit("")) == ""
        out = out.withColumn("descriptor", F.when(bad, F.raise_error(F.concat(F.lit("no descriptor for code "), "code"))).otherwise(F.col("descriptor")))
    return out


def core_terms(descriptors):
    """Distinct search tokens of an array of texts, in order."""
    return F.array_distinct(F.flatten(F.transform(descriptors, T.search_tokens)))


def expansion_table(spark: SparkSession) -> DataFrame:
    """term, expansions (tokens, in order): fixed, of a few kilobytes."""
    rows = [(k, v) for k, v in K.TERM_EXPANSIONS.items()]
    return spark.createDataFrame(rows, "term string, wording array<string>").select("term", F.flatten(F.transform("wording", T.search_tokens)).alias("expansions"))


def query_terms(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, core) with terms: the core and the expansions of its terms, in order, each once."""
    flat = cases.select("case_id", F.posexplode("core").alias("at", "term")).join(F.broadcast(expansion_table(cases.sparkSession)), "term")
    more = flat.groupBy("case_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "expansions"))), lambda x: x["expansions"])).alias("more"))
    return cases.join(more, "case_id", "left").withColumn("terms", F.array_distinct(F.concat("core", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


# ---- units


def _lead_ins(rows: pd.DataFrame) -> pd.DataFrame:
    """The lead-in chain of each paragraph of one document, in reading order: the open introduction and the items above."""
    intro, intro_depth, parents, chains = "", None, {}, []
    for text, scope in zip(rows["text"], rows["scope"], strict=True):
        if scope is None:
            intro, intro_depth, parents = "", None, {}
            chains.append([])
            continue
        first = (text or "").split("\n", 1)[0]
        body = first.lstrip()
        depth = (len(first) - len(body)) // 2
        if body.startswith(("- ", "* ")):
            if intro and intro_depth is None:
                intro_depth = depth
            elif intro and depth < intro_depth:
                intro, intro_depth = "", None
            parents = {d: t for d, t in parents.items() if d < depth} | {depth: " ".join(body[2:].split())}
        else:
            intro, intro_depth, parents = (" ".join(text.split()) if text.rstrip().endswith(":") else ""), None, {}
        chains.append([*([intro] if intro else []), *(parents[d] for d in sorted(parents) if d < depth)])
    return pd.DataFrame({"doc_id": rows["doc_id"], "block": rows["block"], "lead_in": chains})


def lead_ins(paras: DataFrame) -> DataFrame:
    """doc_id, block, lead_in for paragraphs (doc_id, block, text, scope): a fold over a document's paragraphs."""
    kind = paras.schema["doc_id"].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        rows["scope"] = [s if isinstance(s, str) else None for s in rows["scope"]]
        return _lead_ins(rows)

    return paras.select("doc_id", "block", "text", "scope").groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, block int, lead_in array<string>")


def units(blocks: DataFrame, scopes: tuple[str, ...] = ("exclusion", "limitation", "definition")) -> DataFrame:
    """Citable sentences: doc_id, block, unit (order inside the block), text, lead_in, scope, breadcrumb, section_path,
    pages, printed pages, form_code, context.

    Paragraph sentences stay if they have tokens and are no fragment, no talk about the document and citable. Rows of
    in-scope tables stay if they state a limit; their scope is limitation."""
    b = blocks.withColumn("breadcrumb", T.breadcrumb("section_path")).withColumn("scope", T.scope_of("breadcrumb"))
    b = b.withColumn("scope", F.when(F.col("scope").isin(*scopes), F.col("scope")))
    paras = b.where("kind = 'para'")
    about = ["doc_id", "block", "breadcrumb", "section_path", "page_start", "page_end", "form_code", "printed_start", "printed_end", "scope"]
    said = paras.where("scope is not null").select(*about, F.col("text").alias("context"), F.posexplode(T.sentences("text")).alias("unit", "text"))
    said = said.where((F.size(T.search_tokens("text")) > 0) & ~T.is_fragment("text") & ~T.is_meta("text") & T.is_citable("scope", "text"))
    said = said.join(lead_ins(paras), ["doc_id", "block"])
    tables = b.where("kind = 'table' and scope is not null")
    rows = row_sentences(tables.select("doc_id", "block", "text")).where(F.col("sentence").rlike(K.LIMIT_LANGUAGE))
    limits = rows.select("doc_id", "block", F.col("pos").alias("unit"), T.squeeze("sentence").alias("unit_text")).join(tables.select(*about, F.substring("text", 1, 1200).alias("context")), ["doc_id", "block"])
    limits = limits.withColumns({"scope": F.lit("limitation"), "lead_in": F.array().cast("array<string>")}).withColumnRenamed("unit_text", "text").where(F.size(T.search_tokens("text")) > 0)
    cols = [*about, "context", "unit", "text", "lead_in"]
    return said.select(*cols).unionByName(limits.select(*cols))


# ---- weights and scores


def idf_table(units: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """term, df, idf = ln(1 + n / (1 + df)) over units (text); with ``by``, for each group of units."""
    n = units.groupBy(*by).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    df = units.select(*by, F.explode(F.array_distinct(T.search_tokens("text"))).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(n, list(by)) if by else df.join(F.broadcast(n))  # without groups n is one row
    return joined.select(*by, "term", "df", F.log1p(F.col("n") / (1 + F.col("df"))).alias("idf"))


def score(weight, n_matched, n_terms, n_tokens):
    """Weight of the matched terms, by coverage of the query, damped for long sentences."""
    brevity = 1 / (1 + F.log1p(F.greatest(n_tokens - 12, F.lit(0))))
    return F.round(weight * (0.5 + n_matched / F.greatest(n_terms, F.lit(1))) * brevity, 4)


#: The rarest terms of a case, which give the first guess of its best provisions.
RARE_TERMS = 3
#: Cases whose terms are broadcast; beyond it they are dealt out by term.
MAX_CASES = 20_000


def search(cases: DataFrame, units: DataFrame, idf: DataFrame | None = None, top: int = 8) -> DataFrame:
    """The ``top`` provisions of each case: case_id, rank, unit_id, scope, score, matched, distinctive, core_matched, best_idf.

    cases: case_id, core, terms. units: unit_id, text, scope. idf: term, idf; by default counted over the units, for the
    asked terms only. Cases are the stated query set; their terms meet the units' postings by a join on the term.

    Common terms bring nearly all units and little weight, so units are looked up by a case's essential terms only: the
    score of the units that match one of its ``RARE_TERMS`` rarest gives a bound that the last of the ``top`` reaches,
    and the most common terms whose weights together stay under it cannot lift a unit into the result by themselves.
    What is found so is scored by all terms: the result is exact."""
    small = F.broadcast if cases.limit(MAX_CASES + 1).count() <= MAX_CASES else (lambda df: df)
    asked = cases.select("case_id", "core", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "term"))
    split = units.select("unit_id", F.coalesce("scope", F.lit("exclusion")).alias("scope"), F.array_distinct(T.search_tokens("text")).alias("tokens"))
    postings = split.select("unit_id", F.explode("tokens").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    if idf is None:
        df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = df.select("term", F.log1p(F.lit(max(units.count(), 1)) / (1 + F.col("df"))).alias("idf"))
    weighted = asked.join(idf.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    by_weight = Window.partitionBy("case_id").orderBy("idf", "at")
    upto = by_weight.rowsBetween(Window.unboundedPreceding, 0)
    weighted = weighted.withColumns({
        "rarity": F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("idf"), "at")),
        "most": F.sum("idf").over(upto) * (0.5 + F.row_number().over(by_weight) / F.col("n_terms")),
    }).select("case_id", "at", "term", "idf", "n_terms", "rarity", "most", F.array_contains("core", F.col("term")).alias("is_core"))
    weighted = cases.sparkSession.createDataFrame(weighted.collect(), weighted.schema) if small is F.broadcast else weighted
    profiles = weighted.groupBy("case_id", "n_terms").agg(F.array_sort(F.collect_list(F.struct("at", "term", "idf", "is_core"))).alias("ts"))

    def best(chosen: DataFrame, limit: int) -> DataFrame:
        pairs = postings.join(small(chosen.select("case_id", "term")), "term").select("case_id", "unit_id").distinct()
        both = pairs.join(split, "unit_id").join(small(profiles), "case_id")
        found = both.withColumn("m", F.filter("ts", lambda x: F.array_contains("tokens", x["term"])))
        # the sum goes over the terms in order, so that it does not depend on how rows were dealt
        weight = F.aggregate("m", F.lit(0.0), lambda s, x: s + x["idf"])
        raw = score(weight, F.size("m"), F.col("n_terms"), F.size("tokens"))
        found = found.withColumn("score", F.when(F.col("scope") == "definition", F.round(raw * K.DEFINITION_WEIGHT, 4)).otherwise(raw)).where("score > 0")
        order = Window.partitionBy("case_id").orderBy(F.desc("score"), "unit_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    bound = best(weighted.where(F.col("rarity") <= RARE_TERMS), top).where(F.col("rank") == top).select("case_id", F.col("score").alias("bound"))
    # scores are rounded to four digits
    essential = weighted.join(bound, "case_id", "left").where(F.col("most") + 1e-3 >= F.coalesce("bound", F.lit(0.0)))
    terms = lambda keep: F.transform(F.filter("m", keep), lambda x: x["term"])
    return best(essential, top).select(
        "case_id", "rank", "unit_id", "scope", "score", terms(lambda x: F.lit(True)).alias("matched"), terms(lambda x: x["idf"] >= K.DISTINCTIVE_IDF).alias("distinctive"),
        terms(lambda x: x["is_core"]).alias("core_matched"), F.coalesce(F.array_max(F.transform("m", lambda x: x["idf"])), F.lit(0.0)).alias("best_idf"),
    )


# ---- verdicts


def assess(top: DataFrame) -> DataFrame:
    """The verdict on each case from its first provision: ``top`` (case_id, score, scope, matched, distinctive,
    core_matched, best_idf, conflicts, text) -> outcome, gates, needs_human_review. Cases without provisions (null score)
    are not_found."""
    any_hit = F.col("score").isNotNull()
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    thin = any_hit & (n("matched") < 2)
    rare = thin & (F.col("best_idf") >= K.HIGHLY_DISTINCTIVE_IDF)
    common = any_hit & ~thin & (n("distinctive") < 1)
    widened = any_hit & ~thin & ~common & (n("core_matched") == 0)
    conflict = any_hit & (n("conflicts") > 0)
    defined = any_hit & (F.col("scope") == "definition") & ~(thin | common | widened | conflict)
    s = F.coalesce("score", F.lit(0.0))
    outcome = (
        F.when(conflict, "not_found")
        .when(thin | common | widened | defined, F.when(s >= K.SUPPORTED, "weak").when((rare | widened) & (s >= K.WEAK), "weak").otherwise("not_found"))
        .when(s >= K.SUPPORTED, "supported").when(s >= K.WEAK, "weak").otherwise("not_found")
    )
    gates = F.filter(F.array(F.when(thin, "thin"), F.when(rare, "rare_term"), F.when(common, "common_wording"), F.when(widened, "expansion_only"), F.when(conflict, "conflict"), F.when(defined, "definition")), lambda g: g.isNotNull())
    exception = T.exception_clause(F.coalesce("text", F.lit("")))
    out = top.withColumns({"outcome": outcome, "gates": gates, "exception_clause": exception, "cross_references": F.slice(T.cross_references(F.coalesce("text", F.lit(""))), 1, 3)})
    return out.withColumn("needs_human_review", (F.col("outcome") != "supported") | F.col("exception_clause").isNotNull())


NOT_FOUND = (
    "NO SUPPORTING PLAN PROVISION FOUND.\n\nDo not draft a denial citing plan language from this search. "
    "Establish the actual basis for the determination first."
)


def citation_block(assessed: DataFrame, provisions: DataFrame, most: int = 2) -> DataFrame:
    """case_id, block: the verbatim quotes of a verdict's first provisions, or the fixed refusal.

    provisions: case_id, rank, citation, lead_in, text."""
    indent = lambda i: F.repeat(F.lit("    "), i)
    quoted = F.when(F.size("lead_in") > 0, F.concat(F.lit("Quoted text:\n"), F.array_join(F.concat(F.transform("lead_in", lambda p, i: F.concat(indent(i + 1), p)), F.array(F.concat(indent(F.size("lead_in") + 1), F.col("text")))), "\n"))).otherwise(F.concat(F.lit('Quoted text: "'), F.col("text"), F.lit('"')))
    exc, refs = T.exception_clause("text"), T.cross_references("text")
    lines = F.concat_ws("\n", F.concat(F.lit("Plan provision: "), F.col("citation")), quoted, F.concat(F.lit("  ** Exception in this provision: "), exc), F.when(F.size(refs) > 0, F.concat(F.lit("  ** Cross-references: "), F.array_join(refs, ", "))))
    own = provisions.where(F.col("rank") <= most).select("case_id", F.struct("rank", lines.alias("s")).alias("p")).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "\n\n").alias("s"))
    tail = F.when(F.col("outcome") == "weak", "\n\nREVIEW REQUIRED: match confidence is low.").otherwise("")
    out = assessed.select("case_id", "outcome").join(own, "case_id", "left")
    return out.select("case_id", F.when(F.col("outcome") == "not_found", NOT_FOUND).otherwise(F.concat(F.coalesce("s", F.lit("")), tail)).alias("block"))


def accuracy(results: DataFrame) -> DataFrame:
    """checked, passed and the failing cases of results (case_id, expected, outcome); rows without expectation are left
    out."""
    r = results.where("coalesce(expected, '') <> ''")
    ok = F.col("expected") == F.col("outcome")
    return r.agg(F.count(F.lit(1)).alias("checked"), F.count_if(ok).alias("passed"), F.array_sort(F.collect_list(F.when(~ok, F.col("case_id")))).alias("failures"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases on which two search paths give different verdicts (case_id, outcome each)."""
    return a.select("case_id", F.col("outcome").alias("left_outcome")).join(b.select("case_id", F.col("outcome").alias("right_outcome")), "case_id", "full").where(~F.col("left_outcome").eqNullSafe(F.col("right_outcome")))


def reranked(provisions: DataFrame, scorer, top: int = 8) -> DataFrame:
    """Provisions (case_id, rank, query, text) in the order of a pluggable scorer (lists of queries and texts to scores),
    with the old rank as lexical_rank. Where the scorer fails on a batch, each case that has a part in it keeps its order
    whole, and rerank_error says why."""

    def score_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got, error = [None] * len(p), None
            try:
                got = scorer(p["query"].tolist(), p["text"].tolist())
            except Exception as e:  # noqa: BLE001  an outside service must not lose the search's own result
                error = f"{type(e).__name__}: {e}"
            yield p.assign(rerank_score=pd.array(got, "Float64"), rerank_error=error)

    schema = provisions.schema.simpleString()[len("struct<") : -1]
    scored = provisions.mapInPandas(score_batches, f"{schema},rerank_score:double,rerank_error:string")
    failed = F.max("rerank_error").over(Window.partitionBy("case_id"))
    scored = scored.withColumn("rerank_error", failed).withColumn("rerank_score", F.when(F.col("rerank_error").isNull(), F.col("rerank_score")))
    w = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.withColumn("lexical_rank", F.col("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
