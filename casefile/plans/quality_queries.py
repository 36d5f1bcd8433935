"""Checks before a build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators import groups, quality, similarity
from casefile.plans import group_queries as G
from casefile.plans import matching_queries as M
from casefile.plans import planning_queries as PL
from casefile.plans.catalog import query
from casefile.plans.sql import with_views
from casefile.plans.text_queries import _SETS, NEAR_STEPS
from casefile.session import cut_lineage
from casefile.sources import views

KEYS = ["matter_id"]
COLUMNS = ["matter_id", "check_id", "severity", "label", "detail", "source_sha256", "candidate_id"]
NULLS = "CAST(NULL AS VARCHAR) AS source_sha256, CAST(NULL AS VARCHAR) AS candidate_id"


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    seq = F.col("seq")
    rows = G.candidates(spark, folder).withColumn("citation_count", (seq % 3 + 1).cast("int"))
    rows = rows.withColumn("citation_ordinal", F.when(seq % 2 == 0, 1)).withColumn("mark", F.concat(F.lit("AH "), seq.cast("string")))
    return rows


CAND = ("vc", "SELECT *, CAST(seq % 3 + 1 AS INT) AS citation_count, CASE WHEN seq % 2 = 0 THEN 1 END AS citation_ordinal, concat('AH ', seq) AS mark FROM v_candidates")
R_UNMATCHED = ("r_unmatched", (
    "SELECT matter_id, concat('unmatched-', candidate_id) AS check_id, 'blocking' AS severity, 'Unmatched exhibit' AS label, concat(CASE WHEN manual_addition THEN description WHEN citation_count > 1 AND citation_ordinal > 0 THEN "
    "concat('Paragraph ', paragraph, ', reference ', citation_ordinal, ' of ', citation_count, ',') ELSE concat('Paragraph ', paragraph) END, ' has no selected source file.') AS detail, CAST(NULL AS VARCHAR) AS source_sha256, candidate_id FROM vc WHERE included AND evidence_id IS NULL"))
R_UNCONFIRMED = ("r_unconfirmed", f"SELECT matter_id, concat('unconfirmed-', candidate_id) AS check_id, 'blocking' AS severity, 'Unconfirmed exhibit' AS label, concat(mark, ' has not been confirmed by a reviewer.') AS detail, {NULLS} FROM vc WHERE included AND NOT confirmed")


@query(sql=with_views(["v_candidates"], CAND, R_UNMATCHED, select="SELECT * FROM r_unmatched"))
def check_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unmatched(_candidates(spark, folder), KEYS)


@query(sql=with_views(["v_candidates"], CAND, R_UNCONFIRMED, select="SELECT * FROM r_unconfirmed"))
def check_unconfirmed(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unconfirmed(_candidates(spark, folder), KEYS)


def _attached(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attachment, its conversation standing for the e-mail of a matter."""
    turn, parent = F.col("turn"), F.col("parent_id")
    kind = (parent + turn) % 6
    rows = views.attachments(spark, folder)
    decision = F.when(turn % 4 == 0, "leave-out").when(turn % 4 == 1, "print-with-email").when(turn % 4 == 2, "add-as-exhibit")
    return rows.select(
        parent.alias("matter_id"), F.concat(F.lit("c"), parent.cast("string")).alias("candidate_id"),
        F.concat(F.lit("mail-"), parent.cast("string"), F.lit(".eml")).alias("source_name"),
        F.concat(F.lit("h"), parent.cast("string")).alias("source_sha256"),
        F.concat_ws(":", F.concat(F.lit("h"), parent.cast("string")), "ordinal", "child_sha256").alias("identity"),
        F.col("raw_name").alias("name"), (kind != 5).alias("supported"), decision.alias("disposition"),
        F.when(kind == 3, "xlsx").otherwise("other").alias("extension"), "child_sha256",
    )


ATT = ("att", (
    "SELECT parent_id AS matter_id, concat('c', parent_id) AS candidate_id, concat('mail-', parent_id, '.eml') AS source_name, concat('h', parent_id) AS source_sha256, concat('h', parent_id, ':', ordinal, ':', child_sha256) AS identity, raw_name AS name, "
    "(parent_id + turn) % 6 <> 5 AS supported, CASE turn % 4 WHEN 0 THEN 'leave-out' WHEN 1 THEN 'print-with-email' WHEN 2 THEN 'add-as-exhibit' END AS disposition, CASE WHEN (parent_id + turn) % 6 = 3 THEN 'xlsx' ELSE 'other' END AS extension, child_sha256 FROM v_attachments"))
R_ATTACHMENT = ("r_attachment", (
    "SELECT matter_id, concat('email-attachment-', candidate_id, '-', identity) AS check_id, 'blocking' AS severity, 'Email attachment needs a decision' AS label, concat(source_name, ' includes ', name, '. Choose Print with this email, Add as its own exhibit, or Leave out.') AS detail, source_sha256, candidate_id "
    "FROM att WHERE coalesce(disposition, '') <> 'leave-out' AND (NOT supported OR disposition IS NULL) UNION ALL "
    "SELECT matter_id, concat('email-attachment-unsupported-', candidate_id, '-', identity), 'blocking', 'Unsupported email attachment', concat(name, ' cannot be converted. Leave it out.'), source_sha256, candidate_id FROM att WHERE NOT supported AND disposition IS NOT NULL AND disposition <> 'leave-out'"))


@query(sql=with_views(["v_attachments"], ATT, R_ATTACHMENT, select="SELECT * FROM r_attachment"))
def check_attachments(spark: SparkSession, folder: str) -> DataFrame:
    return quality.attachment_checks(_attached(spark, folder), KEYS)


SHEETS_SQL = (
    "SELECT child_sha256, concat('Sheet', n) AS sheet_name, (length(child_sha256) + n + ascii(child_sha256)) % 3 = 0 AS included, CASE WHEN ascii(child_sha256) % 2 = 0 THEN 0 ELSE 5 END AS cell_count "
    "FROM (SELECT DISTINCT child_sha256 FROM v_attachments WHERE ascii(child_sha256) % 5 <> 0) x, (VALUES (1), (2)) t(n)"
)


R_ATTACHED_BOOKS = [
    ("att_sheet", SHEETS_SQL), ("att_print", "SELECT * FROM att WHERE disposition = 'print-with-email' AND extension = 'xlsx'"),
    ("att_book", "SELECT p.*, s.anyi FROM att_print p LEFT JOIN (SELECT child_sha256, bool_or(included) AS anyi FROM att_sheet GROUP BY 1) s USING (child_sha256)"),
    ("r_attached_books", (
    "SELECT matter_id, concat('email-xlsx-unreadable-', candidate_id, '-', identity) AS check_id, 'blocking' AS severity, 'Unreadable workbook' AS label, concat(name, ' could not be analysed for printing with ', source_name, '.') AS detail, child_sha256 AS source_sha256, candidate_id FROM att_book WHERE anyi IS NULL "
    "UNION ALL SELECT matter_id, concat('email-xlsx-none-', candidate_id, '-', identity), 'blocking', 'No worksheet selected', concat('Select at least one worksheet for ', name, ' before printing it with ', source_name, '.'), child_sha256, candidate_id FROM att_book WHERE NOT anyi "
    "UNION ALL SELECT matter_id, concat('email-xlsx-empty-', candidate_id, '-', identity, '-', sheet_name), 'blocking', 'Unreadable worksheet', concat(name, ' / ', sheet_name, ' has no readable cells in its selected range.'), child_sha256, candidate_id FROM att_print JOIN att_sheet USING (child_sha256) WHERE included AND cell_count = 0"
    )),
]


@query(sql=with_views(["v_attachments"], ATT, *R_ATTACHED_BOOKS, select="SELECT * FROM r_attached_books"))
def check_attached_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    hashes = views.attachments(spark, folder).select("child_sha256").distinct().filter(F.ascii("child_sha256") % 5 != 0)
    sheets = hashes.select("child_sha256", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select(
        "child_sha256", F.concat(F.lit("Sheet"), F.col("n").cast("string")).alias("sheet_name"),
        ((F.length("child_sha256") + F.col("n") + F.ascii("child_sha256")) % 3 == 0).alias("included"),
        F.when(F.ascii("child_sha256") % 2 == 0, 0).otherwise(5).alias("cell_count"),
    )
    return quality.attached_workbook_checks(_attached(spark, folder), sheets, KEYS)


R_NUMBERS = ("r_numbers", f"SELECT matter_id, concat('duplicate-AH1:', n) AS check_id, 'blocking' AS severity, 'Duplicate index number' AS label, concat('AH1:', n, ' is assigned more than once.') AS detail, {NULLS} FROM (SELECT matter_id, exhibit_number // 2 AS n FROM grp) x GROUP BY matter_id, n HAVING count(*) > 1")


@query(sql=with_views(["v_candidates"], *G.GROUP_STEPS, R_NUMBERS, select="SELECT * FROM r_numbers"))
def check_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _numbers(G.candidates(spark, folder))


def _numbers(rows: DataFrame) -> DataFrame:
    found = groups.derive_groups(rows, KEYS)
    return quality.duplicate_numbers(found.withColumn("exhibit_number", F.floor(F.col("exhibit_number") / 2)), KEYS)


R_REPEATS = ("r_repeats", (
    f"SELECT g.matter_id, concat('repeat-pending-', g.source_sha256) AS check_id, 'blocking' AS severity, 'Repeat source decision required' AS label, concat(m.n, ' citation(s) select identical file content. Confirm whether they are the same exhibit or separate exhibits.') AS detail, {NULLS} "
    "FROM grp g JOIN (SELECT matter_id, source_sha256, count(*) AS n FROM sel WHERE r = 1 OR repeat_decision = 'same' GROUP BY ALL) m ON m.matter_id = g.matter_id AND m.source_sha256 = g.source_sha256 WHERE decision_pending "
    f"UNION ALL SELECT matter_id, concat('repeat-selection-', source_sha256), 'blocking', 'Conflicting repeat selection', concat('AH ', seq, ' has conflicting page ranges or worksheet selections across citations. Align them before confirming one exhibit.'), {NULLS} FROM grp WHERE selection_conflict"))


def _repeats(rows: DataFrame) -> DataFrame:
    found = groups.derive_groups(rows, KEYS).withColumn("mark", F.concat(F.lit("AH "), F.col("seq").cast("string")))
    members = groups.group_members(rows, KEYS).withColumn("paragraph", F.col("seq"))
    return quality.repeat_checks(found, members, KEYS)


@query(sql=with_views(["v_candidates"], *G.GROUP_STEPS, R_REPEATS, select="SELECT * FROM r_repeats"))
def check_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return _repeats(G.candidates(spark, folder))


def _file_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One file per order, several orders of a matter sharing a content."""
    key = F.col("o_orderkey")
    # every attribute follows from the content, as it would for real files
    content = key % 30
    status = F.when(content % 5 == 0, "completed").when(content % 5 == 1, "failed").when(content % 5 == 2, "unavailable").otherwise("not-needed")
    return views.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("matter_id"), F.concat(F.lit("f"), content.cast("string")).alias("source_id"),
        F.concat(F.lit("h"), content.cast("string")).alias("sha256"), F.when(content % 2 == 0, "pdf").otherwise("txt").alias("extension"),
        (content * 10 * 1024 * 1024).alias("bytes"), (content % 7 == 0).alias("encrypted"), status.alias("ocr_status"),
        F.when(content % 11 == 0, "Timed out.").alias("ocr_failure_reason"), F.lit(3).alias("page_count"),
        F.when(content % 6 == 0, " ").when(content % 6 == 1, "two words").otherwise("three plain words").alias("text"),
    )


FILES = ("files", (
    "SELECT DISTINCT o_custkey AS matter_id, concat('f', k) AS source_id, concat('h', k) AS sha256, k % 2 = 0 AS pdf, k * 10 AS mb, k % 7 = 0 AS encrypted, CASE k % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unavailable' ELSE 'not-needed' END AS st, "
    "CASE WHEN k % 11 = 0 THEN ' Timed out.' ELSE '' END AS why, k % 6 AS t FROM (SELECT o_custkey, o_orderkey % 30 AS k FROM orders) x"))
R_FILES = ("r_files", " UNION ALL ".join(
    f"SELECT matter_id, concat('{prefix}', source_id) AS check_id, '{severity}' AS severity, {label} AS label, {detail} AS detail, sha256 AS source_sha256, CAST(NULL AS VARCHAR) AS candidate_id FROM files WHERE {test}"
    for prefix, severity, label, detail, test in [
        ("large-source-", "warning", "'Large source file'", "concat(mb, ' MB. Local processing may take longer; keep the application open until final validation completes.')", "mb >= 100"),
        ("encrypted-", "blocking", "'Encrypted PDF'", "'Remove password protection before building.'", "encrypted"),
        ("ocr-complete-", "pass", "'OCR completed locally'", "'A searchable text layer was generated at 300dpi.'", "pdf AND st = 'completed'"),
        ("ocr-", "blocking", "CASE WHEN st = 'failed' THEN 'OCR failed' ELSE 'OCR unavailable' END", "CASE WHEN st = 'failed' THEN concat('Local OCR could not create usable searchable text for this PDF.', why) ELSE 'This PDF needs local OCR, which is unavailable in this environment.' END", "pdf AND st IN ('failed', 'unavailable')"),
        ("sparse-", "warning", "'Very little extracted text'", "'Check scan quality and legibility.'", "pdf AND t < 2"),
        ("blank-", "warning", "'Blank or unreadable document'", "'No usable text was found; visually confirm this file is not blank.'", "t = 0"),
    ]))


@query(sql=with_views([], FILES, R_FILES, select="SELECT * FROM r_files"))
def check_sources(spark: SparkSession, folder: str) -> DataFrame:
    return quality.source_checks(_file_sources(spark, folder), KEYS)


def _with_matter(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    owner = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("matter_id"))
    return rows.join(owner, "source_id").withColumn("sha256", F.concat(F.lit("h"), F.col("source_id").cast("string")))


R_ROTATION = ("r_rotation", (
    "SELECT matter_id, concat('rotation-', source_id) AS check_id, 'warning' AS severity, 'Rotated pages' AS label, concat(count(*), ' page(s) have a non-zero rotation and should be visually reviewed.') AS detail, concat('h', source_id) AS source_sha256, CAST(NULL AS VARCHAR) AS candidate_id FROM rot GROUP BY matter_id, source_id "
    "UNION ALL SELECT matter_id, concat('rotated-annotations-', source_id), 'blocking', 'Rotated PDF annotations cannot be preserved safely', concat(count(*), "
    "' page(s) combine page rotation with PDF annotations. Flatten the rotation and annotations in a trusted PDF application, then replace this source file.'), concat('h', source_id), NULL FROM rot WHERE has_annotations GROUP BY matter_id, source_id"))
ROT = ("rot", "SELECT o_custkey AS matter_id, p.* FROM v_pages p JOIN orders ON o_orderkey = source_id WHERE rotation % 360 <> 0")


@query(sql=with_views(["v_pages"], ROT, R_ROTATION, select="SELECT * FROM r_rotation"))
def check_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rotation_checks(_with_matter(spark, folder, views.source_pages(spark, folder)), KEYS)


ACT = ("act", "SELECT o_custkey AS matter_id, a.*, row_number() OVER (PARTITION BY source_id ORDER BY page, location, action) AS n, count(*) OVER (PARTITION BY source_id) AS c FROM v_actions a JOIN orders ON o_orderkey = source_id")
R_ACTIONS = ("r_actions", (
    "SELECT matter_id, concat('active-pdf-actions-', source_id) AS check_id, 'blocking' AS severity, 'Active PDF actions are not permitted' AS label, concat(count(*), "
    "' active action(s). Flatten or remove the actions in a trusted PDF application, then replace this source file. Ordinary visual annotations and internal page links remain supported.') AS detail, concat('h', source_id) AS source_sha256, CAST(NULL AS VARCHAR) AS candidate_id FROM act GROUP BY matter_id, source_id"))


@query(sql=with_views(["v_actions"], ACT, R_ACTIONS, select="SELECT * FROM r_actions"))
def check_actions(spark: SparkSession, folder: str) -> DataFrame:
    return quality.action_checks(_with_matter(spark, folder, views.actions(spark, folder)), KEYS)


R_WORKBOOKS = [
    ("wb_bk", "SELECT s_suppkey AS source_id, s_nationkey AS matter_id, concat('h', s_suppkey) AS sha256 FROM supplier"),
    ("wb_sh", "SELECT source_id, concat('Sheet', k) AS sheet_name, CASE WHEN k = 1 THEN 'hidden' ELSE 'visible' END AS state, k = 0 AND source_id % 4 <> 0 AS included, CASE WHEN source_id % 5 = 0 THEN 0 ELSE n END AS cell_count FROM (SELECT sheet_id AS source_id, row_no % 3 AS k, count(*) AS n FROM v_cells WHERE sheet_id % 9 <> 0 GROUP BY ALL) z"),
    ("wb_nt", "SELECT source_id, sheet_name, CASE WHEN source_id % 2 = 0 THEN 'Fidelity check failed: cut.' ELSE 'Drawings.' END AS warning FROM wb_sh"),
    ("wb_b", "SELECT wb_bk.*, a FROM wb_bk LEFT JOIN (SELECT source_id, bool_or(included) AS a FROM wb_sh GROUP BY 1) s USING (source_id)"),
    ("wb_e", "SELECT * FROM wb_bk JOIN wb_sh USING (source_id)"),
    ("r_workbooks", (
        "SELECT matter_id, concat('xlsx-unreadable-', source_id) AS check_id, 'blocking' AS severity, 'Unreadable workbook' AS label, 'Workbook analysis was not available.' AS detail, sha256 AS source_sha256, CAST(NULL AS VARCHAR) AS candidate_id FROM wb_b WHERE a IS NULL "
            "UNION ALL SELECT matter_id, concat('xlsx-none-', source_id), 'blocking', 'No worksheet selected', 'Select at least one visible worksheet to include.', sha256, NULL FROM wb_b WHERE NOT a "
            "UNION ALL SELECT matter_id, concat('xlsx-empty-', source_id, '-', sheet_name), 'blocking', 'Unreadable worksheet', concat(sheet_name, ' has no readable cells in its selected range.'), sha256, NULL FROM wb_e WHERE included AND cell_count = 0 "
            "UNION ALL SELECT matter_id, concat('xlsx-hidden-', source_id, '-', sheet_name), 'warning', 'Hidden worksheet not selected', concat(sheet_name, ' is ', state, ' and is not selected.'), sha256, NULL FROM wb_e WHERE state <> 'visible' AND NOT included "
            "UNION ALL SELECT matter_id, concat('xlsx-plan-', source_id, '-', sheet_name, '-', warning), CASE WHEN warning LIKE 'Fidelity%' THEN 'blocking' ELSE 'warning' END, CASE WHEN warning LIKE 'Fidelity%' THEN 'Workbook print area would omit content' ELSE 'Worksheet print note' END, concat(sheet_name, ': ', warning), sha256, NULL FROM wb_e JOIN wb_nt USING (source_id, sheet_name) WHERE included"
    )),
]


@query(sql=with_views(["v_cells"], *R_WORKBOOKS, select="SELECT * FROM r_workbooks"))
def check_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    books = views.table(spark, folder, "supplier").select(
        key.alias("source_id"), F.col("s_nationkey").alias("matter_id"), F.concat(F.lit("h"), key.cast("string")).alias("sha256")
    )
    third = F.col("row_no") % 3
    cells = views.cells(spark, folder).filter("sheet_id % 9 <> 0").select(
        F.col("sheet_id").alias("source_id"), F.concat(F.lit("Sheet"), third.cast("string")).alias("sheet_name"),
        F.when(third == 1, "hidden").otherwise("visible").alias("state"), ((third == 0) & (F.col("sheet_id") % 4 != 0)).alias("included"),
    )
    sheets = cells.groupBy("source_id", "sheet_name", "state", "included").agg(F.count(F.lit(1)).alias("n"))
    sheets = sheets.withColumn("cell_count", F.when(F.col("source_id") % 5 == 0, 0).otherwise(F.col("n"))).drop("n")
    note = F.when(F.col("source_id") % 2 == 0, "Fidelity check failed: cut.").otherwise("Drawings.")
    return quality.workbook_checks(books, sheets, sheets.select("source_id", "sheet_name", note.alias("warning")), KEYS)


COPY = [
    ("claims", "SELECT DISTINCT matter_id, evidence_id AS source_id FROM v_candidates WHERE included AND evidence_id IS NOT NULL"),
    ("outside", "SELECT * FROM v_sources ANTI JOIN claims USING (matter_id, source_id)"),
    ("cps", "SELECT * FROM outside SEMI JOIN (SELECT matter_id, sha256 FROM v_sources SEMI JOIN claims USING (matter_id, source_id)) h USING (matter_id, sha256)"),
    ("r_copies", (
        f"SELECT matter_id, concat('duplicate-', sha256) AS check_id, 'warning' AS severity, 'Duplicate source files' AS label, concat('Identical source hashes: ', count(*), ' files.') AS detail, {NULLS} FROM v_sources GROUP BY matter_id, sha256 HAVING count(*) > 1 "
        f"UNION ALL SELECT matter_id, 'duplicate-physical-copies', 'warning', 'Unselected duplicate physical copies', concat(count(*), ' file(s) contain identical content to a selected source and will remain outside the bundle.'), {NULLS} FROM cps GROUP BY matter_id "
        f"UNION ALL SELECT matter_id, 'unreferenced', 'warning', 'Unreferenced evidence', concat(count(*), ' supplied file(s) are outside the confirmed bundle.'), {NULLS} FROM outside GROUP BY matter_id")),
]


def _copies(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    return quality.copy_checks(views.sources(spark, folder), _selected(rows), KEYS)


@query(sql=with_views(["v_sources", "v_candidates"], *COPY, select="SELECT * FROM r_copies"))
def check_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder, G.candidates(spark, folder))


def _selected(rows: DataFrame) -> DataFrame:
    return rows.filter("included AND evidence_id IS NOT NULL").select("matter_id", F.col("evidence_id").alias("source_id"))


MEMBERS = " UNION ALL ".join([
    "SELECT matter_id, concat('rotation-', source_id) AS check_id, CAST(page AS VARCHAR) AS position, concat('page ', page) AS member FROM rot",
    "SELECT matter_id, concat('rotated-annotations-', source_id), CAST(page AS VARCHAR), concat('page ', page) FROM rot WHERE has_annotations",
    "SELECT matter_id, concat('active-pdf-actions-', source_id), CAST(page AS VARCHAR), concat('page ', page, ' ', location, ' /', action) FROM act",
    "SELECT matter_id, concat('duplicate-', sha256), CAST(source_seq AS VARCHAR), name FROM v_sources SEMI JOIN (SELECT matter_id, sha256 FROM v_sources GROUP BY ALL HAVING count(*) > 1) t USING (matter_id, sha256)",
    "SELECT matter_id, 'duplicate-physical-copies', CAST(source_seq AS VARCHAR), name FROM cps",
    "SELECT s.matter_id, concat('repeat-pending-', s.source_sha256), CAST(s.seq AS VARCHAR), concat('paragraph ', s.paragraph) FROM sel s JOIN grp g ON s.matter_id = g.matter_id AND s.source_sha256 = g.source_sha256 WHERE g.decision_pending AND (s.r = 1 OR s.repeat_decision = 'same')",
])


@query(sql=with_views(["v_candidates", "v_pages", "v_actions", "v_sources"], *G.GROUP_STEPS, ROT, ACT, *COPY[:3], select=MEMBERS))
def finding_members(spark: SparkSession, folder: str) -> DataFrame:
    """What the findings count, one row each, at every size."""
    rows = G.candidates(spark, folder)
    found, members = groups.derive_groups(rows, KEYS), groups.group_members(rows, KEYS).withColumn("paragraph", F.col("seq"))
    sources = views.sources(spark, folder)
    parts = [
        quality.page_members(_with_matter(spark, folder, views.source_pages(spark, folder)), KEYS),
        quality.action_members(_with_matter(spark, folder, views.actions(spark, folder)), KEYS),
        quality.copy_members(sources, _selected(rows), KEYS),
        quality.repeat_members(found, members, KEYS),
    ]
    return reduce(DataFrame.unionByName, parts)


def sql_decorated(source: str) -> str:
    whens = " ".join(f"WHEN '{label}' THEN '{code}'" for label, code in quality.CODES.items())
    legal = ", ".join(f"'{x}'" for x in quality.HARD_LEGAL)
    return (
        f"SELECT *, CASE label {whens} ELSE concat('build.', check_id) END AS code, CASE WHEN label IN ('OCR failed', 'OCR unavailable') THEN 'exception-eligible' "
        f"WHEN label IN ({legal}) THEN 'hard-legal' WHEN severity = 'blocking' THEN 'hard-technical' ELSE 'warning' END AS policy FROM {source}"
    )


PREFLIGHT = [
    CAND, *G.GROUP_STEPS, R_UNMATCHED, R_UNCONFIRMED, R_REPEATS, FILES, R_FILES, ROT, R_ROTATION, ACT, R_ACTIONS, *COPY, ATT, R_ATTACHMENT, *R_ATTACHED_BOOKS, R_NUMBERS, *R_WORKBOOKS,
    ("found", " UNION ALL ".join(f"SELECT {', '.join(COLUMNS)} FROM {r}" for r in ("r_unmatched", "r_unconfirmed", "r_attachment", "r_attached_books", "r_numbers", "r_repeats", "r_files", "r_rotation", "r_actions", "r_workbooks", "r_copies"))),
    ("allc", f"SELECT * FROM found UNION ALL SELECT c_custkey, 'ready', 'pass', 'Ready to build', 'No blocking preflight issue was found.', {NULLS} FROM customer WHERE c_custkey NOT IN (SELECT matter_id FROM found WHERE severity = 'blocking')"),
]


@query(sql=with_views(["v_candidates", "v_pages", "v_actions", "v_sources", "v_attachments", "v_cells"], *PREFLIGHT, select=sql_decorated("allc")))
def preflight_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(_candidates(spark, folder))
    rules = [
        quality.unmatched(rows, KEYS), quality.unconfirmed(rows, KEYS), check_attachments(spark, folder), check_attached_workbooks(spark, folder),
        _numbers(rows), _repeats(rows), check_workbooks(spark, folder),
        quality.source_checks(_file_sources(spark, folder), KEYS),
        quality.rotation_checks(_with_matter(spark, folder, views.source_pages(spark, folder)), KEYS),
        quality.action_checks(_with_matter(spark, folder, views.actions(spark, folder)), KEYS),
        _copies(spark, folder, rows),
    ]
    matters = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("matter_id"))
    return quality.run_preflight(rules, matters, KEYS)


APPLIED = [
    *M.MATCH_STEPS,
    ("upd", (
        "SELECT c.matter_id, c.check_id, CASE WHEN ok THEN 'warning' ELSE severity END AS severity, label, CASE WHEN ok THEN concat(detail, ' Approved exception: the original PDF will be included without a tool-generated OCR text layer.') ELSE detail END AS detail, code, policy FROM ("
        "SELECT c.*, coalesce(action = 'proceed-without-ocr' AND label IN ('OCR failed', 'OCR unavailable') AND policy = 'exception-eligible' AND v, false) AS ok FROM checks c LEFT JOIN first_hit USING (matter_id, check_id)) c")),
]


@query(
    sql=with_views(
        [], *APPLIED,
        select=(
            "SELECT * FROM upd UNION ALL SELECT m.c_custkey, CASE WHEN r THEN 'ready-after-exceptions' ELSE 'ready' END, 'pass', CASE WHEN r THEN 'Ready with approved exceptions' ELSE 'Ready to build' END, "
            "CASE WHEN r THEN 'No unresolved blocking issue remains; one or more technical exceptions are recorded below.' ELSE 'No blocking preflight issue was found.' END, NULL, NULL FROM (SELECT c_custkey, c_custkey IN (SELECT matter_id FROM resolutions) AS r FROM customer) m WHERE c_custkey NOT IN (SELECT matter_id FROM upd WHERE severity = 'blocking')"
        ),
    )
)
def apply_resolutions(spark: SparkSession, folder: str) -> DataFrame:
    matters = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("matter_id"))
    return quality.apply_resolutions(M.checks_table(spark, folder), M.resolutions_table(spark, folder), matters, KEYS)


@query(
    sql=with_views(
        ["v_candidates"], ("res", M.RESOLUTIONS_SQL),
        ("x", "SELECT *, (matter_id, candidate_id) IN (SELECT (matter_id, candidate_id) FROM res WHERE action = 'exclude-candidate') OR coalesce((matter_id, evidence_id, source_sha256) IN (SELECT (matter_id, source_id, source_sha256) FROM res WHERE action = 'exclude-source' AND source_sha256 IS NOT NULL), false) AS o FROM v_candidates"),
        select="SELECT matter_id, candidate_id, included AND NOT o AS included, confirmed AND NOT o AS confirmed FROM x",
    )
)
def exclude_by_resolution(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.exclude_by_resolution(G.candidates(spark, folder), M.resolutions_table(spark, folder), KEYS)
    return rows.select("matter_id", "candidate_id", "included", "confirmed")


@query(
    sql=with_views(
        [], ("res", M.RESOLUTIONS_SQL),
        ("f", "SELECT DISTINCT o_custkey AS matter_id, concat('e', o_orderkey % 9) AS source_id, concat('h', o_orderkey % 7) AS sha256 FROM orders"),
        select="SELECT DISTINCT f.matter_id, f.source_id FROM f JOIN res r ON r.matter_id = f.matter_id AND r.source_sha256 = f.sha256 WHERE action = 'proceed-without-ocr' AND (check_code LIKE 'ocr.%' OR blocker_id = concat('ocr-', f.source_id))",
    )
)
def skip_ocr(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    files = views.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("matter_id"), F.concat(F.lit("e"), (key % 9).cast("string")).alias("source_id"),
        F.concat(F.lit("h"), (key % 7).cast("string")).alias("sha256"),
    ).distinct()
    return quality.skip_ocr(files, M.resolutions_table(spark, folder), KEYS).select("matter_id", "source_id")


_SLOT_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'cover' WHEN 1 THEN 'index' WHEN 2 THEN 'divider' ELSE 'exhibitCover' END"


def _slot() -> Column:
    kind = F.col("o_orderkey") % 4
    return F.when(kind == 0, "cover").when(kind == 1, "index").when(kind == 2, "divider").otherwise("exhibitCover")


@query(
    sql=(
        f"SELECT DISTINCT r.o_custkey AS matter_id, r.slot FROM (SELECT o_custkey, {_SLOT_SQL} AS slot, o_orderkey % 3 AS h FROM orders WHERE o_orderkey % 5 = 0) r "
        f"JOIN (SELECT DISTINCT o_custkey, {_SLOT_SQL} AS slot, o_custkey % 3 AS h FROM orders) t USING (o_custkey, slot, h)"
    )
)
def template_fallback(spark: SparkSession, folder: str) -> DataFrame:
    orders = views.table(spark, folder, "orders")
    key, matter = F.col("o_orderkey"), F.col("o_custkey").alias("matter_id")
    resolutions = orders.filter(key % 5 == 0).select(
        matter, F.lit("use-built-in-template").alias("action"), F.create_map(_slot(), (key % 3).cast("string")).alias("template_hashes")
    )
    templates = orders.select(matter, _slot().alias("slot"), (F.col("o_custkey") % 3).cast("string").alias("sha256")).distinct()
    return quality.template_fallback(resolutions, templates, KEYS)


@query(
    sql=(
        "SELECT o_custkey AS matter_id, concat('t', o_orderkey) AS slot, CASE WHEN k % 11 = 0 THEN 'template changed after it was selected' WHEN k % 3 <> 0 AND k % 7 = 0 THEN 'no converted PDF' WHEN k % 13 = 0 OR (k % 3 = 0 AND k % 7 = 0) THEN 'rendered PDF differs from the reviewed one' "
        "WHEN k % 5 = 0 THEN 'matter details not reviewed' WHEN k % 17 = 0 THEN 'matter details not confirmed' WHEN k % 3 <> 0 AND k % 2 = 0 THEN 'appearance not confirmed' WHEN k % 4 = 1 AND k % 6 <> 1 THEN 'placeholders not confirmed' END AS reason FROM (SELECT *, o_orderkey AS k FROM orders) x"
    )
)
def template_gate(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    good, other = F.lit("r"), F.lit("x")

    def unless(bad: Column) -> Column:
        return F.when(bad, other).otherwise(good)

    rows = views.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("matter_id"), F.concat(F.lit("t"), k.cast("string")).alias("slot"),
        F.when(k % 3 == 0, "pdf").otherwise("docx").alias("format"), F.lit("s").alias("declared_sha256"),
        F.when(k % 11 == 0, "y").otherwise("s").alias("actual_sha256"), unless(k % 13 == 0).alias("rendered_declared"),
        F.when(k % 7 != 0, "r").alias("rendered_actual"), unless(k % 5 == 0).alias("reviewed_sha256"),
        unless(k % 17 == 0).alias("matter_confirmed_sha256"), unless(k % 2 == 0).alias("appearance_confirmed_sha256"),
        unless(k % 6 != 1).alias("placeholder_confirmed_sha256"), (k % 4 == 1).alias("has_placeholders"),
    )
    return quality.template_gate(rows, KEYS)


@query(
    sql=with_views(
        ["v_candidates", *PL._NODES], *PL.COUNTED_STEPS,
        ("fl", "SELECT matter_id, exhibit_id, row_number() OVER (PARTITION BY matter_id ORDER BY pos, inner_pos) AS at FROM v_nodes WHERE exhibit_id NOT LIKE '%7'"),
        select=(
            "SELECT coalesce(p.matter_id, f.matter_id) AS matter_id, 'index and plan order differ' AS issue, coalesce(p.item_id, f.exhibit_id) AS subject FROM plan p FULL JOIN fl f ON f.matter_id = p.matter_id AND f.exhibit_id = p.item_id WHERE p.position IS DISTINCT FROM f.at"
        ),
        recursive=True,
    )
)
def plan_issues(spark: SparkSession, folder: str) -> DataFrame:
    """A build plan against an index that lost the exhibits whose id ends in 7."""
    from casefile.operators import arrangement

    lost = PL.nodes(spark, folder).filter(~F.col("exhibit_id").endswith("7"))
    return quality.plan_issues(PL._planned(spark, folder), arrangement.flatten_arrangement(lost, KEYS), KEYS, overhead=2)


@query(
    sql=with_views(
        ["v_candidates"], ("checks", M.CHECKS_SQL), *G.PENDING_STEPS,
        ("cnt", "SELECT matter_id, count(*) FILTER (included AND parent_sha256 IS NULL) AS i, count(*) FILTER (included AND evidence_id IS NOT NULL AND confirmed AND parent_sha256 IS NULL) AS c FROM v_candidates GROUP BY 1"),
        ("num", "SELECT matter_id, i, greatest(i - c, coalesce(p, 0)) AS n FROM cnt LEFT JOIN (SELECT matter_id, count(*) AS p FROM pending GROUP BY 1) q USING (matter_id)"),
        select=(
            "SELECT matter_id, 'no-included-exhibits' AS blocker_id, 'No exhibits included' AS label, 'Include at least one exhibit before building the exhibit bundle.' AS detail, 'state' AS kind, 'review' AS target, 'Return to exhibit review' AS action FROM num WHERE i = 0 "
            "UNION ALL SELECT matter_id, 'exhibit-approvals', 'Exhibit approvals required', concat(n, ' included exhibit', CASE WHEN n = 1 THEN ' is' ELSE 's are' END, ' still awaiting confirmation. Use the outstanding-approvals filter to locate ', CASE WHEN n = 1 THEN 'it' ELSE 'them' END, '.'), 'approval', 'review', concat('Review ', n, ' exhibit match', CASE WHEN n = 1 THEN '' ELSE 'es' END) FROM num WHERE n > 0 "
            "UNION ALL SELECT matter_id, concat('preflight-', check_id), label, detail, 'preflight', 'review', CASE WHEN code LIKE 'ocr.%' THEN 'Review OCR issue' ELSE 'Open the exhibit card' END FROM checks "
            "UNION ALL SELECT c_custkey, 'template-approval', 'Template review required', concat('Complete the outstanding template review: ', c_mktsegment, '.'), 'template', 'templates', 'Review template' FROM customer WHERE c_custkey % 10 = 0"
        ),
    )
)
def readiness_blockers(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.candidates(spark, folder)
    found = groups.derive_groups(rows, KEYS)
    counts = groups.progress_counts(rows, found, groups.pending_reviews(rows, found, KEYS), KEYS)
    open_ = views.table(spark, folder, "customer").filter("c_custkey % 10 = 0").select(
        F.col("c_custkey").alias("matter_id"), F.col("c_mktsegment").alias("name")
    )
    return quality.readiness_blockers(counts, M.checks_table(spark, folder), KEYS, open_)


@query(
    sql=with_views(
        [], *_SETS, *NEAR_STEPS,
        select="SELECT concat('near-duplicate-', left_id, '-', right_id) AS check_id, 'warning' AS severity, 'Possible near-duplicate sources' AS label, "
        f"concat('doc-', left_id, ' and doc-', right_id, ' have unusually similar extracted text (', percent, '%). Review them before selecting both.') AS detail, {NULLS} FROM near",
    )
)
def check_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    sources = views.table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text")
    pairs = similarity.near_duplicates(sources)
    name = lambda c: F.concat(F.lit("doc-"), F.col(c).cast("string"))
    return quality.near_duplicate_checks(pairs.withColumns({"left_name": name("left_id"), "right_name": name("right_id")}), [])
