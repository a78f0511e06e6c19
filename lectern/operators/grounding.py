"""Draft answers against their evidence: claims, verdicts, a second search, repair, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import claims as C
from ..functions import fixed, text
from . import retrieval

KEY = ["answer_id", "line_index", "claim_index"]
ACCEPTED = ("SUPPORTED", "PARTIALLY_SUPPORTED")


def extract(answers: DataFrame) -> DataFrame:
    """answers (answer_id, draft) as claims: answer_id, line_index, claim_index, text, bare, kind, cited."""
    lines = answers.select("answer_id", F.posexplode(C.answer_lines(F.col("draft"))).alias("line_index", "sentences"))
    rows = lines.select("answer_id", "line_index", F.posexplode("sentences").alias("claim_index", "text")).where(F.length("text") >= 3)
    rows = rows.withColumn("bare", C.bare(F.col("text"))).where("bare <> ''")
    return rows.withColumns({"kind": C.claim_kind(F.col("bare")), "cited": C.cited(F.col("text"))})


def validate_citations(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answers (answer_id, draft), labels (answer_id, label): answer_id, cited, valid, invalid, penalty. Case doesn't matter;
    penalty is half the invalid ones' share."""
    own = labels.groupBy("answer_id").agg(F.collect_set(F.lower(F.trim("label"))).alias("labels"))
    rows = answers.select("answer_id", C.cited(F.col("draft")).alias("cited")).join(own, "answer_id", "left")
    known = F.coalesce("labels", F.array().cast("array<string>"))
    valid = F.filter("cited", lambda c: F.array_contains(known, F.lower(c)))
    invalid = F.filter("cited", lambda c: ~F.array_contains(known, F.lower(c)))
    penalty = F.when(F.size("cited") > 0, 0.5 * F.size(invalid) / F.size("cited")).otherwise(0.0)
    return rows.select("answer_id", "cited", valid.alias("valid"), invalid.alias("invalid"), penalty.alias("penalty"))


def confidence(best: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.coalesce(best, F.lit(1.0)), F.lit(1.0)) - penalty))


def _state(status: str, score: Column | float, reason: str, second: bool = False, listing: bool = True) -> Column:
    score = score if isinstance(score, Column) else F.lit(float(score))
    return F.struct(F.lit(status).alias("status"), score.alias("score"), F.lit(reason).alias("reason"), F.lit(second).alias("second"), F.lit(listing).alias("listing"))


def verify(claims: DataFrame, context: DataFrame, replies: DataFrame | None = None, cfg: EngineConfig = DEFAULTS, strict: bool = False) -> DataFrame:
    """claims with status, score, reason, repaired, evidence (array<struct<pos,label,page,id,text>>), supporting, second.

    context: answer_id, pos, label, page, id, text, a few rows for each answer, gathered as one array. All features are
    columns and the decision is one chain over them. replies (KEY, reply): a verifier's JSON for claims that the first stage
    leaves open (see `open_claims`); without one the cautious heuristics decide. `second` marks what a second search may
    still rescue.
    """
    ctx = context.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.lower(F.trim("label")).alias("label"), "page", "id", "text"))).alias("ctx"))
    rows = claims.join(ctx, "answer_id", "left")
    empty = F.slice("ctx", 1, 0)
    rows = rows.withColumn("ctx", F.coalesce("ctx", empty, F.from_json(F.lit("[]"), rows.schema["ctx"].dataType)))
    valid = F.filter("cited", lambda c: F.exists("ctx", lambda x: x["label"] == F.lower(c)))
    rows = rows.withColumn("valid", valid)
    wrong = (F.size("cited") > 0) & (F.size("valid") == 0)
    quoted = F.flatten(F.transform("valid", lambda c: F.filter("ctx", lambda x: x["label"] == F.lower(c))))
    rows = rows.withColumn("evidence", F.when(wrong, F.slice("ctx", 1, 0)).when(F.size("valid") > 0, quoted).otherwise(F.col("ctx")))
    bare, ev = F.col("bare"), F.col("ev")
    rows = rows.withColumn("ev", F.array_join(F.transform("evidence", lambda x: x["text"]), "\n"))
    rows = rows.withColumns({"nums": C.numeric_tokens(bare), "overlap": text.overlap(bare, ev), "negated": C.negation_risk(bare, ev, strict), "list": C.enumeration(bare, ev)})
    rows = rows.withColumns({"missing": C.missing_numbers(F.col("nums"), ev), "risky": F.col("kind").isin("causal", "comparison", "conclusion") | C.is_major(bare)})
    if replies is not None:
        rows = rows.join(replies.select(*KEY, "reply"), KEY, "left").withColumn("said", C.verdict(F.col("reply")))
    else:
        rows = rows.withColumn("said", F.lit(None).cast("struct<status:string,score:double,reason:string,pages:array<string>>"))
    seen = F.filter("said.pages", lambda p: F.exists("evidence", lambda x: x["label"] == F.lower(p)))
    rows = rows.withColumn("seen", seen)
    ov, has = F.col("overlap"), F.size("valid") > 0
    weak = (F.col("said.status") == "SUPPORTED") & (F.size("evidence") > 0) & (F.size("seen") == 0)
    told = F.struct(
        F.when(weak, F.lit("PARTIALLY_SUPPORTED")).otherwise(F.col("said.status")).alias("status"), F.when(weak, F.least("said.score", F.lit(0.6))).otherwise(F.col("said.score")).alias("score"),
        F.substring(F.coalesce(F.nullif("said.reason", F.lit("")), F.lit("semantic verifier")), 1, 300).alias("reason"), (~F.col("said.status").isin(*ACCEPTED)).alias("second"), F.col("said.status").isin(*ACCEPTED).alias("listing"),
    )
    said = F.col("said").isNotNull()
    cue = text.any_in(F.lower(bare), fixed.AGGREGATION_CUES)
    summed = cue & F.exists("missing", lambda x: F.coalesce(C.derived(F.regexp_replace(C.normal_number(x), "%+$", "").try_cast("double"), ev), F.lit(False)))
    approx = F.exists("nums", lambda x: C.hedged(x, ev) & ~C.hedged(x, bare))
    metric = C.metric_mismatch(bare, ev)
    numeric = (
        F.when(summed, _state("SUPPORTED", 0.8, "value matches deterministic sum of evidence figures", listing=False))
        .when(F.size("missing") > 0, _state("UNSUPPORTED", 0.0, "figure not present in evidence", second=True))
        .when((has | (ov >= 0.5)) & ~approx & ~F.col("negated") & ~metric, _state("SUPPORTED", F.greatest(ov, F.lit(0.6)), "figure matches evidence exactly (Stage 1)"))
        .when(said, F.struct(told["status"].alias("status"), told["score"].alias("score"), told["reason"].alias("reason"), F.lit(False).alias("second"), told["listing"].alias("listing")))
        .when(approx, _state("PARTIALLY_SUPPORTED", ov, "evidence states this figure as approximate; claim asserts it as exact"))
        .when(F.col("negated"), _state("UNCERTAIN", 0.0, "negation cue present; cannot verify polarity without semantic check"))
        .when(metric, _state("UNCERTAIN", 0.0, "claim names a specific metric not found alongside this figure in the evidence"))
        .otherwise(_state("PARTIALLY_SUPPORTED", ov, "figure present but low overall overlap (Stage 2 unavailable)"))
    )
    trusted = F.when(has, F.greatest(ov, F.lit(0.6))).otherwise(ov)
    plain = (
        F.when(~F.col("negated") & ~F.col("risky") & ((has & (ov >= 0.5)) | (ov >= 0.6)), _state("SUPPORTED", trusted, "high lexical overlap with cited evidence (Stage 1)"))
        .when(said, told)
        .when(F.col("negated"), _state("UNCERTAIN", 0.0, "negation cue present; cannot verify polarity without semantic check", True, False))
        .when(F.col("risky") & (ov < 0.6), F.struct(F.lit("UNCERTAIN").alias("status"), ov.alias("score"), F.concat(F.lit("'"), F.col("kind"), F.lit("' claims require semantic verification to accept")).alias("reason"), F.lit(True).alias("second"), F.lit(False).alias("listing")))
        .when(has | (ov >= cfg.claim_support_threshold) | (text.word_count(bare) <= 4), _state("SUPPORTED", trusted, "lexical overlap heuristic (Stage 2 unavailable)", True))
        .when(ov >= cfg.claim_partial_threshold, _state("PARTIALLY_SUPPORTED", ov, "partial lexical overlap heuristic (Stage 2 unavailable)", True))
        .otherwise(_state("UNSUPPORTED", ov, "no lexical overlap with evidence", True, False))
    )
    state = (
        F.when(F.col("kind") == "conversational", _state("NOT_FACTUAL", 0.0, "", listing=False))
        .when(wrong, _state("UNSUPPORTED", 0.0, "cited page is not part of the supplied evidence", True, False))
        .when(F.size("nums") > 0, numeric).otherwise(plain)
    )
    rows = rows.withColumn("state", state)
    items, kept = F.col("list.items"), F.col("list.kept")
    cut = F.col("state.listing") & (items > kept)
    # A figure that was missing may go with its item; a verifier's word on what is left then counts.
    late = (F.size("nums") > 0) & (F.size("missing") > 0) & said & F.col("state.second") & ~(cut & (kept > 0))
    status = F.when(late, told["status"]).when(cut & (kept > 0), F.lit("PARTIALLY_SUPPORTED")).when(cut, F.lit("UNSUPPORTED")).otherwise(F.col("state.status"))
    score = F.when(late, told["score"]).when(cut, kept / items).otherwise(F.col("state.score"))
    reason = F.when(late, told["reason"]).when(cut & (kept > 0), F.concat((items - kept).cast("string"), F.lit(" of "), items.cast("string"), F.lit(" listed item(s) not found in evidence and removed"))).otherwise(F.col("state.reason"))
    out = rows.withColumns({"status": status, "score": score, "reason": reason, "repaired": F.when(cut & (kept > 0), F.col("list.repaired"))})
    return out.select(
        *KEY, "text", "bare", "kind", "cited", "nums", "status", "score", "reason", "repaired", "evidence", F.when(F.size("seen") > 0, F.col("seen")).alias("supporting"),
        (F.col("state.second") & ~F.col("status").isin(*ACCEPTED)).alias("second"),
    )


def open_claims(verified: DataFrame) -> DataFrame:
    """What a semantic verifier should see: factual claims that the first stage neither passed nor failed by a citation or a
    missing sum. Filter first, so a provider is called for these rows only."""
    decided = F.col("reason").rlike(r"\(Stage 1\)$|^value matches|^cited page|listed item")
    return verified.where((F.col("kind") != "conversational") & ~decided)


def other_evidence(claims: DataFrame, answers: DataFrame, chunks: DataFrame, cfg: EngineConfig = DEFAULTS, most: int = 3) -> DataFrame:
    """(KEY, chat_id, id, ord, overlap, rank): for each claim (KEY, bare, evidence) up to `most` chunks of the answer's chat
    that aren't its evidence and have enough of its significant tokens, those with the most first, then in reading order."""
    want = claims.select(*KEY, text.significant(F.col("bare")).alias("own"), F.transform("evidence", lambda x: x["id"]).alias("ids")).join(answers.select("answer_id", "chat_id"), "answer_id")
    pairs = retrieval.token_overlap(want, KEY, chunks).where(F.col("overlap") >= cfg.claim_support_threshold)
    pairs = pairs.join(want.select(*KEY, "ids"), KEY).where(~F.array_contains("ids", F.col("id")))
    return retrieval.ranked(pairs.drop("ids"), KEY, F.desc("overlap"), F.col("ord")).where(F.col("rank") <= most)


def second_search(verified: DataFrame, answers: DataFrame, chunks: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """verified with failing claims rescued by up to three other chunks of the chat: each overlaps the claim enough, all its
    figures are in them, and together they overlap by half. answers: answer_id, chat_id; chunks: chat_id, id, ord, page, text.
    """
    want = verified.where("second")
    top = other_evidence(want, answers, chunks, cfg).join(chunks.select("chat_id", "id", "page", "text"), ["chat_id", "id"])
    item = F.struct(F.col("rank").alias("pos"), F.col("page").cast("string").alias("label"), "page", "id", "text")
    got = top.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("found")).join(want.select(*KEY, F.col("bare").alias("b"), F.col("nums").alias("n")), KEY)
    joined = F.array_join(F.transform("found", lambda x: x["text"]), "\n")
    got = got.withColumn("ov", text.overlap(F.col("b"), joined)).where((F.size(C.missing_numbers(F.col("n"), joined)) == 0) & (F.col("ov") >= 0.5)).select(*KEY, "found", "ov")
    rows = verified.join(got, KEY, "left")
    hit = F.col("found").isNotNull()
    kind = verified.schema["evidence"].dataType.simpleString()
    return rows.withColumns(
        {
            "status": F.when(hit, F.lit("SUPPORTED")).otherwise(F.col("status")), "score": F.when(hit, F.col("ov")).otherwise(F.col("score")),
            "reason": F.when(hit, F.lit("found via secondary search of the document (not in the originally retrieved context)")).otherwise(F.col("reason")),
            "evidence": F.when(hit, F.col("found").cast(kind)).otherwise(F.col("evidence")), "cited": F.when(hit, F.slice("cited", 1, 0)).otherwise(F.col("cited")),
            "supporting": F.when(~hit, F.col("supporting")),
        }
    ).drop("found", "ov")


def pages(verified: DataFrame) -> Column:
    """The claim's pages as strings: the verifier's, else the evidence's, each once."""
    own = F.array_distinct(F.transform("evidence", lambda x: x["page"].cast("string")))
    return F.coalesce("supporting", own)


def repair(answers: DataFrame, verified: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(answer_id, grounded_answer): what stays of each line, with page marks where the draft had none; blank lines stay, two
    newlines at most. Nothing factual accepted, or nothing left, however many claims fell: the message that it isn't in the
    document, in the draft's script."""
    accepted = F.col("status").isin(*ACCEPTED)
    marks = F.slice(F.when(F.size("cited") > 0, F.col("cited")).otherwise(F.col("pages")), 1, 3)
    marked = F.concat(F.coalesce("repaired", "text"), F.when(F.size(marks) > 0, F.concat(F.lit(" "), F.array_join(F.transform(marks, lambda p: F.concat(F.lit("[p. "), p, F.lit("]"))), ""))).otherwise(F.lit("")))
    bare = F.col("repaired").isNull() & ((F.size("cited") > 0) | (F.col("status") == "NOT_FACTUAL") | F.lit(not cfg.citation_required))
    shown = F.when(bare, F.col("text")).otherwise(marked)
    rows = verified.withColumn("pages", pages(verified)).withColumn("shown", F.when(accepted | (F.col("status") == "NOT_FACTUAL"), shown))
    lines = rows.groupBy("answer_id", "line_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("claim_index", "shown")))), lambda x: x["shown"]), " ").alias("line"))
    drafts = answers.select("answer_id", "draft", F.posexplode(F.split("draft", "\n", -1)).alias("line_index", "raw"))
    body = drafts.join(lines, ["answer_id", "line_index"], "left")
    keep = F.when(F.col("line") != "", F.col("line")).when(F.col("line").isNull() & (text.strip(F.col("raw")) == ""), F.lit(""))
    text_of = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep.isNotNull(), F.struct("line_index", keep.alias("l"))))), lambda x: x["l"]), "\n")
    grounded = body.groupBy("answer_id").agg(F.first("draft").alias("draft"), text_of.alias("g"))
    facts = rows.where("kind <> 'conversational'").groupBy("answer_id").agg(F.count("*").alias("facts"), F.count_if(accepted).alias("good"))
    out = grounded.join(facts, "answer_id", "left").withColumn("g", F.regexp_replace(text.strip(F.col("g")), r"\n{3,}", "\n\n"))
    lost = ((F.coalesce("facts", F.lit(0)) > 0) & (F.col("good") == 0)) | (F.col("g") == "")
    message = F.when(F.col("draft").rlike(fixed.ARABIC), fixed.NOT_FOUND_AR).otherwise(fixed.NOT_FOUND_EN)
    return out.select("answer_id", F.when(lost, message).otherwise(F.col("g")).alias("grounded_answer"))


def scores(answers: DataFrame, verified: DataFrame, repaired: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, retrieval_score, evidence_coverage, citation_score, grounding_score). Absolute claims weigh double; half
    support counts half; a claim that is shown needs a page that the context has."""
    fact = verified.where("kind <> 'conversational'").withColumn("pages", pages(verified))
    weight = F.when(C.is_major(F.col("text")), fixed.MAJOR_WEIGHT).otherwise(fixed.MINOR_WEIGHT)
    worth = F.when(F.col("status") == "SUPPORTED", 1.0).when(F.col("status") == "PARTIALLY_SUPPORTED", 0.5).otherwise(0.0)
    known = context.groupBy("answer_id").agg(F.collect_set(F.lower(F.trim("label"))).alias("labels"))
    rows = fact.join(repaired, "answer_id").join(known, "answer_id", "left")
    display = F.coalesce("repaired", "text")
    kept = F.col("status").isin(*ACCEPTED) & (text.strip(display) != "") & F.contains("grounded_answer", display)
    named = F.when(F.size("cited") > 0, F.col("cited")).otherwise(F.col("pages"))
    right = F.exists(named, lambda p: F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), F.lower(F.trim(p))))
    got = rows.groupBy("answer_id").agg((F.sum(weight * worth) / F.sum(weight)).alias("cov"), F.avg(F.when(kept, F.when(right, 1.0).otherwise(0.0))).alias("cit"))
    out = answers.select("answer_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("retrieval_score", F.lit(1.0)))).alias("r")).join(got, "answer_id", "left")
    cov, cit, r = F.coalesce("cov", F.lit(1.0)), F.coalesce("cit", F.lit(1.0)), F.col("r")
    return out.select("answer_id", r.alias("retrieval_score"), F.bround(cov, 4).alias("evidence_coverage"), F.bround(cit, 4).alias("citation_score"), F.bround(0.5 * cov + 0.25 * cit + 0.25 * r, 4).alias("grounding_score"))


def ground(answers: DataFrame, context: DataFrame, chunks: DataFrame | None = None, replies: DataFrame | None = None, cfg: EngineConfig = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(claims, report) for answers (answer_id, chat_id, draft, retrieval_score)."""
    verified = verify(extract(answers), context, replies, cfg)
    if chunks is not None:
        verified = second_search(verified, answers, chunks, cfg)
    return verified, report(answers, verified, context, None, cfg)


def report(answers: DataFrame, verified: DataFrame, context: DataFrame, chunks: DataFrame | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(answer_id, retrieval_score, evidence_coverage, citation_score, grounding_score, grounded_answer) from verdicts, after a
    second search through chunks if they are given. Best from a stored table of verdicts, which are read several times."""
    if chunks is not None:
        verified = second_search(verified, answers, chunks, cfg)
    fixed_up = repair(answers, verified, cfg)
    return scores(answers, verified, fixed_up, context).join(fixed_up, "answer_id")
