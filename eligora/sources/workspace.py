"""Stored tables of a workspace: append-only Parquet logs and views on them.

Nothing is updated in place.  A save appends rows with a save number, an
override or a deleted tender appends a row too, and the views give the current
state in the order of these numbers: the latest row of an id wins, a deletion hides
what was saved before it, an override lasts until the next evaluation.  A repeated
save has the same ids and so changes nothing; a failed one leaves no half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import schemas
from eligora.operators import tables as T

_LOGS = {**schemas.TABLES, "deleted_tenders": "tender_id BIGINT"}


class Workspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        """Empty tables where there are none yet."""
        for name, ddl in _LOGS.items():
            empty = self.spark.createDataFrame([], f"{ddl}, seq BIGINT")
            empty.write.mode("ignore").parquet(f"{self.path}/{name}")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{_LOGS[name]}, seq BIGINT").parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame, seq: int, keys: list[str]) -> None:
        """Add rows; ids come from the natural ``keys``, so a repeated save of
        the same rows gives the same ids.  Missing columns are NULL."""
        known = rows.columns
        fields = [f.strip().split(" ")[:2] for f in _LOGS[name].split(",")]
        values = []
        for field, kind in fields:
            if field == "id" and "id" not in known:
                values.append(T.row_id(*keys).alias("id"))
            elif field == "created_at" and field not in known:
                values.append(F.current_timestamp().alias(field))
            else:
                values.append((F.col(field) if field in known else F.lit(None)).cast(kind).alias(field))
        out = rows.select(*values, F.lit(seq).cast("bigint").alias("seq"))
        out.write.mode("append").parquet(f"{self.path}/{name}")

    def audit(self, rows: DataFrame, action: str, tender: str, details: str, seq: int) -> None:
        self.append("audit_log", rows.select(*T.audit(F.col(tender), action, F.expr(details))), seq,
                    ["tender_id", "action", "details"])

    def add_tenders(self, rows: DataFrame, seq: int) -> None:
        self.append("tenders", rows, seq, ["name", "file_hash"])
        named = rows.select(T.row_id("name", "file_hash").alias("tender_id"), "filename")
        self.audit(named, "tender_uploaded", "tender_id", "concat('File: ', filename)", seq)

    def add_bidders(self, rows: DataFrame, seq: int) -> None:
        self.append("bidders", rows, seq, ["tender_id", "name"])
        self.audit(rows, "bidder_added", "tender_id", "concat('Bidder: ', name)", seq)

    def save_criteria(self, new: DataFrame, seq: int) -> None:
        """Merge an edited list over the stored one, see ``tables.merge_criteria``."""
        merged = T.merge_criteria(self.table("criteria"), new, self.table("evidence"), self.table("verdicts"))
        touched = new.select("tender_id").distinct()
        self.append("criteria", merged.join(touched, "tender_id", "left_semi"), seq, ["tender_id", "crit_code"])
        counts = new.groupBy("tender_id").agg(F.count("*").alias("n"))
        self.audit(counts, "criteria_saved", "tender_id", "concat(n, ' criteria')", seq)

    def confirm_criteria(self, tenders: DataFrame, seq: int) -> None:
        confirmed = T.confirm_criteria(self.table("criteria"), tenders).join(tenders, "tender_id", "left_semi")
        self.append("criteria", confirmed, seq, ["tender_id", "crit_code"])
        self.audit(tenders, "criteria_confirmed", "tender_id", "'Officer confirmed criteria list'", seq)

    def proceed(self, tenders: DataFrame, seq: int) -> None:
        """Note that the confirmed list was taken on to the evaluation."""
        self.audit(tenders, "criteria_confirmed_proceed", "tender_id", "'Criteria confirmed, proceeding to evaluation'", seq)

    def add_criterion(self, row: DataFrame, seq: int) -> None:
        """One more criterion by hand: tender_id, crit_code, ord and the editable fields; the others stay."""
        listed = self.table("criteria").join(row.select("tender_id"), "tender_id", "left_semi")
        fields = ["description", "category", "mandatory", "threshold", "expected_evidence", "source_section"]
        old = listed.select("tender_id", "crit_code", F.lit(0).cast("long").alias("ord"), *fields)
        self.save_criteria(old.unionByName(row.select("tender_id", "crit_code", F.col("ord").cast("long"), *fields)), seq)
        self.audit(row, "criterion_added", "tender_id", "concat(crit_code, ': ', description)", seq)

    def save_documents(self, rows: DataFrame, seq: int) -> None:
        """Documents as ``sources.files.ingest`` makes them, with bidder_id and tender_id."""
        self.append("documents", rows, seq, ["bidder_id", "tender_id", "filename", "file_hash"])

    def save_evidence(self, rows: DataFrame, seq: int) -> None:
        """Evidence as ``assess`` returns it; a save's rows are told apart by their ordinal."""
        stored = rows.withColumns({"raw_text": F.col("source_text"), "confidence": F.col("ocr_confidence"), "_save": F.lit(seq)})
        self.append("evidence", stored, seq, ["_save", "bidder_id", "criterion_id", "ordinal"])

    def save_verdicts(self, rows: DataFrame, seq: int) -> None:
        self.append("verdicts", rows, seq, ["bidder_id", "criterion_id"])
        named = rows.groupBy("bidder_id").agg(F.count("*").alias("n")).join(
            self.log("bidders").select(F.col("id").alias("bidder_id"), "tender_id", "name").dropDuplicates(["bidder_id"]), "bidder_id")
        self.audit(named, "bidder_evaluated", "tender_id", "concat('Bidder: ', name, ', ', n, ' criteria')", seq)

    def save_overrides(self, rows: DataFrame, seq: int) -> None:
        """verdict_id, original_verdict, new_verdict, reason; without a reason refused."""
        valid = rows.where(F.trim(F.coalesce("reason", F.lit(""))) != "").withColumn("_save", F.lit(seq))
        self.append("officer_overrides", valid, seq, ["_save", "verdict_id", "new_verdict", "reason"])
        named = valid.join(self._verdict_tenders(), "verdict_id")
        self.audit(named, "officer_override", "tender_id", "concat(original_verdict, ' to ', new_verdict, ': ', reason)", seq)

    def delete_tenders(self, tenders: DataFrame, seq: int) -> None:
        self.append("deleted_tenders", tenders.select("tender_id"), seq, ["tender_id"])

    def wipe(self, seq: int) -> None:
        self.delete_tenders(self.table("tenders").select(F.col("id").alias("tender_id")), seq)

    def compact(self, name: str, path: str) -> None:
        """Write a log's rows as few files to another folder, for a workspace with many small saves."""
        self.log(name).dropDuplicates().repartition(F.col("seq")).write.mode("overwrite").parquet(path)

    def _bidder_tenders(self) -> DataFrame:
        return self.log("bidders").select(F.col("id").alias("bidder_id"), F.col("tender_id").alias("_tender")).distinct()

    def _verdict_tenders(self) -> DataFrame:
        ids = self.log("verdicts").select(F.col("id").alias("verdict_id"), "bidder_id").distinct()
        return ids.join(self._bidder_tenders(), "bidder_id").select("verdict_id", F.col("_tender").alias("tender_id"))

    def _visible(self, name: str) -> DataFrame:
        """Log rows that no later deletion hides; reads only the logs this table hangs on."""
        log, deleted = self.log(name), self.log("deleted_tenders")
        if name == "tenders":
            return T.since_deletion(log, "id", deleted)
        if name in ("criteria", "bidders", "audit_log"):
            return T.since_deletion(log, "tender_id", deleted)
        if name == "officer_overrides":
            named = log.join(self._verdict_tenders().withColumnRenamed("tender_id", "_tender"), "verdict_id", "left")
        else:
            named = log.join(self._bidder_tenders(), "bidder_id", "left")
            if name == "documents":
                named = named.withColumn("_tender", F.coalesce("tender_id", "_tender"))
        return T.since_deletion(named, "_tender", deleted).select(*log.columns)

    def table(self, name: str) -> DataFrame:
        """Current rows of one table."""
        rows = self._visible(name)
        if name == "criteria":
            # A save of a tender's criteria replaces the whole list of that tender.
            last = rows.groupBy("tender_id").agg(F.max("seq").alias("seq"))
            rows = rows.join(last, ["tender_id", "seq"], "left_semi")
        if name == "verdicts":
            columns = [c for c in rows.columns if c != "seq"]
            return T.resolved_verdicts(rows, self._visible("officer_overrides")).select(*columns)
        if name == "audit_log":
            return rows.dropDuplicates(["id", "seq"]).drop("seq")
        return T.latest_rows(rows, ["id"]).drop("seq")
