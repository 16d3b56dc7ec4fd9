"""Language and embedding models behind one small interface.

The engine ships no model.  A client factory is called once per Python worker;
whatever it returns must have ``chat(messages, json_mode, max_tokens)`` and/or
``embed(text)``.  Only the rows that need a model should reach these functions:
filter first, call, then join the replies back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import jsontext as J
from eligora.functions import text as X
from eligora.functions.money import model_money
from eligora.operators.ranking import running_sum
from eligora.session import cut


class ModelNotFound(RuntimeError):
    """The model does not exist; asking again is pointless."""


class ModelClient(Protocol):
    def chat(self, messages: list[dict], json_mode: bool, max_tokens: int) -> str: ...

    def embed(self, text: str) -> list[float]: ...


ClientFactory = Callable[[], ModelClient]
# ``ask`` or a replacement with its leading parameters, such as a partial of ``replies.ask_once``.
Call = Callable[..., DataFrame]


def _with_retries(call: Callable[[], object], retries: int, wait: float):
    for attempt in range(retries + 1):
        try:
            return call()
        except ModelNotFound:
            raise
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait)


def _warm_up(model: ModelClient) -> None:
    """Let a client load its model; whether it could shows in the calls."""
    warm_up = getattr(model, "warm_up", None)
    if warm_up:
        try:
            warm_up()
        except Exception:
            pass


# Rows of a batch that are Python objects at a time; a batch of long texts is large.
SLICE = 128


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches in slices of few rows, and the values of ``column`` in each."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            rows = batch.slice(start, SLICE)
            yield rows, rows.column(rows.schema.get_field_index(column)).to_pylist()


def _with_columns(rows: pa.RecordBatch, **added: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *added.values()], [*rows.schema.names, *added])


def ask(df: DataFrame, prompt: str, client: ClientFactory, system: str = "", json_mode: bool = True,
        max_tokens: int = K.MODEL_TOKENS, retries: int = K.MODEL_RETRIES,
        wait: float = K.MODEL_RETRY_SECONDS) -> DataFrame:
    """Add ``reply`` and ``error`` columns by one chat call per row.

    A call that keeps failing leaves a NULL reply and its message, so one bad
    row does not fail the job; an unknown model does.  A client that has
    ``warm_up()`` is warmed up once per task before its first call.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, reply string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = client()
        _warm_up(model)
        for rows, texts in _slices(batches, prompt):
            replies, errors = [], []
            for text in texts:
                messages = [{"role": "system", "content": system}] if system else []
                messages.append({"role": "user", "content": text})
                try:
                    replies.append(_with_retries(lambda: model.chat(messages, json_mode, max_tokens), retries, wait))
                    errors.append(None)
                except ModelNotFound:
                    raise
                except Exception as e:
                    replies.append(None)
                    errors.append(str(e))
            yield _with_columns(rows, reply=pa.array(replies, pa.string()), error=pa.array(errors, pa.string()))
    return df.mapInArrow(run, schema)


def _mean(vectors: list[list[float]], weights: list[int]) -> list[float]:
    if len(vectors) < 2:
        return vectors[0] if vectors else []
    total = sum(weights)
    return [sum(w * x for w, x in zip(weights, column)) / total for column in zip(*vectors)]


def embed(df: DataFrame, text: str, client: ClientFactory, column: str = "embedding") -> DataFrame:
    """Add an embedding of ``text``; NULL on failure, empty for blank text.

    A text longer than a call takes is embedded in consecutive pieces, and its
    vector is their mean weighted by length, so that all of it counts.
    """
    schema = (f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, "
              f"`{column}` array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = client()
        for rows, values in _slices(batches, text):
            out = []
            for value in values:
                clean = (value or "").strip()
                pieces = [clean[i:i + K.EMBED_INPUT_CHARS] for i in range(0, len(clean), K.EMBED_INPUT_CHARS)]
                try:
                    vectors = [model.embed(p) for p in pieces]
                    out.append(_mean(vectors, [len(p) for p in pieces]) if all(vectors) else None)
                except Exception:
                    out.append(None)
            yield _with_columns(rows, **{column: pa.array(out, pa.list_(pa.float32()))})
    return df.mapInArrow(run, schema)


# -- evidence ----------------------------------------------------------------

EVIDENCE_SYSTEM = ("Report evidence for one eligibility criterion from the excerpts given. "
                   "State only what they contain. Answer with JSON only.")
EVIDENCE_PROMPT = """Criterion: {description}
Condition: {threshold}
Evidence wanted: {expected_evidence}

Excerpts:
{context}

Answer {"evidence": [{"found": true, "extracted_value": text, "normalized_value": number or null,
"source_text": sentence, "source_document": file name, "notes": text}]}, one entry per separate item,
an empty list when there is none. Amounts are in whole rupees (1 lakh = 100000, 1 crore = 10000000).
"""


def model_extractor(client: ClientFactory, contexts: DataFrame | Callable[[DataFrame], DataFrame], documents: DataFrame, keys: list[str],
                    scan_keys: list[str] | None = None, call: Call = ask) -> Callable[[DataFrame], DataFrame]:
    """Extractor for ``operators.extraction.scan`` that asks a model.

    Batches need source_document, batch, description, threshold and
    expected_evidence; ``contexts`` has their text per ``scan_keys`` (``keys`` by
    default) and batch, or makes it for the distinct keys of a wave; ``documents``
    has the OCR confidence per ``keys``.
    """
    scan_keys = scan_keys or keys
    from eligora.operators.extraction import with_document_confidence

    def extract(batches: DataFrame) -> DataFrame:
        held = contexts(batches.select(*scan_keys).distinct()) if callable(contexts) else contexts
        batches = batches.join(held.select(*scan_keys, "batch", "context"), scan_keys + ["batch"])
        fields = {n: F.coalesce(F.col(n), F.lit(d)) for n, d in
                  (("description", ""), ("threshold", "N/A"), ("expected_evidence", ""), ("context", ""))}
        prompts = batches.withColumn("_prompt", X.fill_template(EVIDENCE_PROMPT, **fields)).drop("context")
        replies = call(prompts, "_prompt", client, EVIDENCE_SYSTEM, True, K.EVIDENCE_TOKENS)
        items = replies.select(*[c for c in replies.columns if c not in ("_prompt", "reply", "error")],
                               F.posexplode(J.evidence_items("reply")).alias("item", "_e"))
        named = F.coalesce(X.non_empty("_e.source_document"), F.col("source_document"))
        rows = items.select(*[c for c in items.columns if c not in ("_e", "source_document")],
                            named.alias("source_document"),
                            *[F.col(f"_e.{n}").alias(n) for n in
                              ("extracted_value", "normalized_value", "source_text", "notes")])
        return with_document_confidence(rows, documents, keys)
    return extract


def no_evidence_rows(batches: DataFrame) -> DataFrame:
    """Extractor where there is no model to ask: finds nothing."""
    columns = {"item": "int", "extracted_value": "string", "normalized_value": "double", "source_text": "string", "notes": "string", "ocr_confidence": "double"}
    return batches.where(F.lit(False)).withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})


# -- verdicts by judgement ---------------------------------------------------

VERDICT_SYSTEM = "Fill one row of a verdicts table as JSON: verdict, explanation, confidence."
VERDICT_PROMPT = """Rule of the tender ({category}; obligatory: {mandatory}): {description}
Limit: {threshold}

What the bidder handed in:
{evidence}

Return {"verdict": one of "ELIGIBLE", "NOT_ELIGIBLE", "NEEDS_REVIEW", "explanation": the reason with its figures and files,
"confidence": number from 0 to 1}.
"""
# Characters of evidence in one call; longer lists are judged in parts.
EVIDENCE_CHARS = 4 * 16384


def evidence_parts(evidence: DataFrame, group: list[str], limit: int = EVIDENCE_CHARS) -> DataFrame:
    """Numbered evidence text per group in parts of about ``limit`` characters: group, part, evidence.

    Numbers run on through the parts.  A part is a range of the running length, so
    no more than ``limit`` characters and one row are ever gathered together; the
    running length is added up over range partitions, so that no task sorts a group.
    """
    line = F.concat(F.lit(". in "), F.coalesce("source_document", F.lit("?")),
                    F.lit(": "), F.coalesce("extracted_value", F.lit("?")),
                    F.lit("\n   wording "), F.coalesce("source_text", F.lit("?")),
                    F.lit("\n   remark "), F.coalesce("notes", F.lit("?")), F.lit("\n"))
    lines = evidence.select(*group, "ordinal", line.alias("_line"))
    summed = running_sum(lines, group, [F.col("ordinal"), F.col("_line")], (F.length("_line") + 8).cast("bigint"), "_n", "_before")
    placed = summed.select(*group, "_line", "_n", F.floor(F.col("_before") / limit).cast("int").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    return placed.groupBy(*group, "part").agg(F.array_join(F.transform(
        ordered, lambda r: F.concat(F.lit("\n"), r["_n"].cast("string"), r["_line"])), "").alias("evidence"))


def evidence_summary(evidence: DataFrame, group: list[str]) -> DataFrame:
    """The whole numbered evidence text per group, for showing."""
    parts = F.array_sort(F.collect_list(F.struct("part", "evidence")))
    return evidence_parts(evidence, group).groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["evidence"]), "").alias("evidence"))


def qualitative_verdicts(pairs: DataFrame, criteria: DataFrame, evidence: DataFrame, client: ClientFactory,
                         system: str = VERDICT_SYSTEM, prompt: str = VERDICT_PROMPT, limit: int = EVIDENCE_CHARS,
                         call: Call = ask) -> DataFrame:
    """Model verdicts; without evidence the fixed rule, on failure a review.

    Evidence of more than ``limit`` characters is judged part by part, and the
    verdicts of the parts are then judged together; all of it is read.
    """
    from eligora.operators.evaluate import PAIR, no_evidence
    parts = evidence_parts(evidence, PAIR, limit)
    rows = pairs.select(*PAIR).join(criteria, "criterion_id").join(parts, PAIR, "left")
    desc = F.coalesce("description", F.lit(""))
    bare = rows.where(F.col("part").isNull()).select(*PAIR, no_evidence(F.col("mandatory"), desc).alias("_v"))
    fields = {"description": desc, "category": F.coalesce("category", F.lit("")),
              "mandatory": F.initcap(F.coalesce("mandatory", F.lit(True)).cast("string")),
              "threshold": F.coalesce("threshold", F.lit("N/A")), "evidence": F.col("evidence")}

    def judged(asked: DataFrame, keys: list[str]) -> DataFrame:
        prompts = asked.select(*keys, X.fill_template(prompt, **fields).alias("_prompt"))
        return call(prompts, "_prompt", client, system).select(*keys, _verdict_of_reply().alias("_v"))
    single = cut(judged(rows.where(F.col("part").isNotNull()), [*PAIR, "part"]))
    counts = single.groupBy(*PAIR).agg(F.count("*").alias("_parts"))
    counted = single.join(counts, PAIR)
    told = F.concat(F.lit("\nPart "), (F.col("part") + 1).cast("string"), F.lit(": "), F.col("_v.verdict"), F.lit(". "), F.col("_v.explanation"))
    several = counted.where("_parts > 1").groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("part", told.alias("t")))).alias("_p"))
    again = several.select(*PAIR, F.array_join(F.transform("_p", lambda p: p["t"]), "").alias("evidence")).join(criteria, "criterion_id")
    return (bare.unionByName(counted.where("_parts = 1").select(*PAIR, "_v")).unionByName(judged(again, PAIR))
            .select(*PAIR, "_v.*"))


def _verdict_of_reply() -> Column:
    """struct<verdict, explanation, confidence> of a reply; a review where it is missing or no JSON."""
    body = J.json_body("reply")
    verdict = F.try_variant_get(body, "$.verdict", "string")
    known = F.when(verdict.isin(K.ELIGIBLE, K.NOT_ELIGIBLE, K.NEEDS_REVIEW), verdict).otherwise(K.NEEDS_REVIEW)
    failed = F.concat(F.lit("Evaluation error: "), F.coalesce("error", F.lit("invalid JSON")), F.lit(". Manual review required."))

    def made(v: Column, text: Column, conf: Column) -> Column:
        return F.struct(v.alias("verdict"), text.alias("explanation"), conf.alias("confidence"))
    return F.when(body.isNull(), made(F.lit(K.NEEDS_REVIEW), failed, F.lit(0.0))).otherwise(made(
        known, F.coalesce(F.try_variant_get(body, "$.explanation", "string"), F.lit("No explanation provided.")),
        F.coalesce(F.try_variant_get(body, "$.confidence", "double"), F.lit(0.5))))


# -- criteria, summaries, amounts --------------------------------------------

CRITERIA_SYSTEM = ("List the distinct eligibility obligations of a tender as JSON. Merge repeated listings, "
                   "invent nothing.")
CRITERIA_PROMPT = """Tender text:
{text}

Answer {"criteria": [{"criterion_id": "C-001", "description": text, "category": "financial" or "experience" or
"compliance" or "technical" or "other", "mandatory": true or false, "threshold": text, "expected_evidence": text,
"source_section": text}]}.
"""


def _overlapping(text: Column, block: int, overlap: int) -> Column:
    """Blocks of ``block`` characters, each but the last sharing ``overlap`` with the next; one for an empty text.

    Cut once into steps by one pattern, so that a long text is walked through once.
    """
    step = block - overlap
    steps = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))

    def joined(s: Column) -> Column:
        # a last step that the block before it holds already makes no block
        inside = (F.size(s) > 1) & (F.length(F.element_at(s, -1)) <= overlap)
        count = F.size(s) - inside.cast("int")
        return F.transform(F.slice(s, 1, F.greatest(count, F.lit(0))), lambda x, i: F.concat(
            x, F.substr(F.coalesce(F.get(s, i + 1), F.lit("")), F.lit(1), F.lit(overlap))))
    cut_up = F.flatten(F.transform(F.array(steps), joined))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut_up)


CRITERION_ITEM = ("struct<description:string,category:string,mandatory:boolean,threshold:string,"
                  "expected_evidence:string,source_section:string>")


def criteria_replies(tenders: DataFrame, client: ClientFactory, block: int = K.CRITERIA_BLOCK_CHARS,
                     overlap: int = K.CRITERIA_OVERLAP_CHARS, call: Call = ask) -> DataFrame:
    """What a model lists for each block of each tender: tender_id, block, items, error.

    ``tenders`` has id and full_text.  A failed call, or a reply that is no JSON or
    has no list of criteria, is a row with its error and no items.
    """
    blocks = tenders.select(F.col("id").alias("tender_id"), F.posexplode(
        _overlapping(F.coalesce("full_text", F.lit("")), block, overlap)).alias("block", "_text"))
    prompts = blocks.select("tender_id", "block", X.fill_template(CRITERIA_PROMPT, text=F.col("_text")).alias("_prompt"))
    replies = call(prompts, "_prompt", client, CRITERIA_SYSTEM).withColumn("_b", J.json_body("reply"))
    listed = F.coalesce(F.try_variant_get("_b", "$.criteria", "array<variant>"), F.try_variant_get("_b", "$", "array<variant>"))

    def item(v: Column) -> Column:
        def field(name: str, default: str) -> Column:
            return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default)).alias(name)
        return F.struct(field("description", ""), field("category", "other"),
                        F.coalesce(F.try_variant_get(v, "$.mandatory", "boolean"), F.lit(True)).alias("mandatory"),
                        field("threshold", ""), field("expected_evidence", ""), field("source_section", ""))
    read = replies.select("tender_id", "block", "error", "_b", listed.alias("_l"))
    problem = (F.when(F.col("_b").isNull(), F.coalesce("error", F.lit("invalid JSON")))
               .when(F.col("_l").isNull(), F.lit("no list of criteria")))
    return read.select("tender_id", "block", F.coalesce(F.transform("_l", item), F.array().cast(f"array<{CRITERION_ITEM}>")).alias("items"),
                       problem.alias("error"))


def read_criteria(tenders: DataFrame, client: ClientFactory, block: int = K.CRITERIA_BLOCK_CHARS,
                  overlap: int = K.CRITERIA_OVERLAP_CHARS, call: Call = ask) -> tuple[DataFrame, DataFrame]:
    """Criteria of whole tenders, near-duplicates merged over all blocks, and the blocks that gave none for an error.

    Criteria keep the order of the text.  The second table has tender_id, block and
    error, so that a tender with a failed block is known to be incomplete.
    """
    from eligora.operators.dedupe import merge_similar
    replies = cut(criteria_replies(tenders, client, block, overlap, call))
    rows = replies.select("tender_id", "block", F.posexplode("items").alias("_i", "_c"))
    ord_ = (F.col("block").cast("bigint") * (1 << 32) + F.col("_i")).alias("ord")
    return (merge_similar(rows.select("tender_id", ord_, "_c.*")),
            replies.where("error is not null").select("tender_id", "block", "error"))


def extract_criteria(tenders: DataFrame, client: ClientFactory, call: Call = ask) -> DataFrame:
    """Criteria of each tender, defaults filled in, near-duplicates merged."""
    return read_criteria(tenders, client, call=call)[0]


SUMMARY_SYSTEM = "Produce the document column of a search index: plain prose, facts only."
SUMMARY_PROMPT = """Source file {name}:

{text}

In one paragraph, tell what a reader could search this text for.
"""


def summarise(documents: DataFrame, keys: list[str], client: ClientFactory, system: str = SUMMARY_SYSTEM,
              prompt: str = SUMMARY_PROMPT, block: int = K.SUMMARY_INPUT_CHARS) -> DataFrame:
    """One search paragraph per document, from the whole text.

    Each block of ``block`` characters is summarised; a document of several blocks
    gets a summary of its blocks' summaries.  A block whose call fails stands for
    itself by its start, so no block is left out; where the last call fails, all the
    blocks' summaries are kept.
    """
    text = F.coalesce("full_text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0))
    blocks = documents.where(~X.is_blank("full_text")).select(*keys, "filename", F.posexplode(pieces).alias("_block", "_text"))

    def told(rows: DataFrame, carried: list[str], otherwise: Column) -> DataFrame:
        # only what stands in for a failed call goes with the prompt, not the text once more
        prompts = rows.select(*carried, otherwise.alias("_otherwise"), X.fill_template(prompt, name=F.col("filename"), text=F.col("_text")).alias("_prompt"))
        replies = ask(prompts, "_prompt", client, system, json_mode=False)
        return replies.select(*carried, F.coalesce(X.strip("reply"), "_otherwise").alias("summary"))

    first = cut(told(blocks, [*keys, "filename", "_block"], X.left("_text", K.SUMMARY_FALLBACK_CHARS)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "summary"))), lambda p: p["summary"]), "\n")
    whole = cut(first.groupBy(*keys, "filename").agg(F.count("*").alias("_n"), joined.alias("_text")))
    return whole.where("_n = 1").select(*keys, F.col("_text").alias("summary")).unionByName(told(whole.where("_n > 1"), keys, F.col("_text")))


MONEY_SYSTEM = "Answer with one JSON object {amount, currency, confidence}."
MONEY_PROMPT = """Which sum of money does this passage state? Give amount as a plain number (null if it states none), currency as
three letters, confidence as a fraction.
>>>
{text}
<<<
"""


def money_with_model(df: DataFrame, key: str | list[str], text: str, client: ClientFactory, call: Call = ask,
                     confidence: float = K.MONEY_MODEL_CONFIDENCE) -> DataFrame:
    """Best amount per row, asking a model only where the rules are unsure.

    ``key`` (columns) tells rows apart.  Unsure are ambiguous texts and those whose
    surest candidate is below ``confidence``; the rules run once per text.
    """
    from eligora.functions import money as M
    keys = [key] if isinstance(key, str) else key
    ruled = df.select(*keys, text, M.money_candidates(text).alias("_c"))
    unsure = M.needs_model(F.col("_c"), confidence) & ~X.is_blank(text)
    ruled = cut(ruled.select(*keys, "_c", F.when(unsure, X.strip(text)).alias("_t")))
    # windows of the whole text that overlap by half, and of these the ones with a digit
    step = K.MONEY_SNIPPET_CHARS // 2
    stripped = ruled.where("_t is not null").select(*keys, "_t")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("_t") - step - 1, F.lit(0)) / step).cast("int"))
    windows = stripped.select(*keys, F.posexplode(F.transform(starts, lambda i: F.substr(F.col("_t"), i * step + 1, F.lit(2 * step)))).alias("_w", "_text"))
    prompts = windows.where((F.col("_w") == 0) | F.col("_text").rlike("[0-9]")).select(*keys, "_w", X.fill_template(MONEY_PROMPT, text=F.col("_text")).alias("_prompt"))
    replies = call(prompts, "_prompt", client, MONEY_SYSTEM, True, K.MONEY_TOKENS)

    def fields(body: Column) -> Column:
        return F.struct(*[F.try_variant_get(body, f"$.{n}", "string").alias(n) for n in ("amount", "currency", "confidence")])
    # an explode, so that neither its filter nor the uses of its fields read a reply again
    amount = X.bind(X.bind(J.json_body("reply"), fields), model_money)
    read = replies.select(*keys, "_w", F.explode(F.array_compact(F.array(amount))).alias("_m"))
    extra = read.groupBy(*keys).agg(F.max_by("_m", F.struct(F.col("_m.confidence"), -F.col("_w"))).alias("_m"))
    joined = ruled.join(extra, keys, "left")
    candidates = F.when(F.col("_m").isNull(), F.col("_c")).otherwise(F.concat("_c", F.array("_m")))
    return joined.select(*keys, M.pick_best(candidates).alias("money"))
