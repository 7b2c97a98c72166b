"""Driver tables -> model frames.

The driver ships TPC-H-like tables; these projections give each operator
real, scale-growing input.  Every mapping is a pure projection or equi-join
(no sampling, no id subsets), so the frames grow with the tables and
Catalyst prunes the scans to the referenced columns.  The DuckDB oracle in
``plans.catalog`` states the same mappings as SQL views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-01 00:00:00"

# Fixed values of the binding (see the SQL twins in catalog.BINDING_SQL).
PRIORITY_TO_STATUS = [("1", "APPLIED"), ("2", "APPROVED"), ("3", "SCORED"),
                      ("4", "FETCHED"), ("5", "REJECTED")]
ORDERSTATUS_TO_PROCESSING = [("O", "IDLE"), ("P", "QUEUED"), ("F", "PROCESSING")]
MAIL_DOMAIN = "@mail.example"
UNKNOWN_SENDER = "noreply@unknown.example"
MAIL_SHAPES = {
    # event_type: (subject, body)
    "error": ("Status update", "Unfortunately we went with other candidates."),
    "purchase": ("Application status", "We would like to invite you to an interview."),
    "view": ("Update", "Thank you for your message."),
    "click": ("Newsletter", "Our latest news."),
    "signup": ("Status update", "Unfortunately the position is closed."),
}
EVENT_TO_ACTION = [("click", "approve"), ("view", "notes"), ("error", "ignore"),
                   ("purchase", "dispatched")]
SIGNUP_REJECT_FROM = 200.0   # signup events with value >= this are "reject", else "analyze"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col, pairs, default=None):
    out = None
    for k, v in pairs:
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default) if default is not None else out


def postings(spark: SparkSession, sf_dir: str, with_customer: bool = True) -> DataFrame:
    """orders LEFT JOIN customer -> posting model frame (id = o_orderkey).

    Views that never read title, company or description pass
    ``with_customer=False``: Catalyst cannot drop a left join whose right
    side it does not know to be unique, and at scale that join is a full
    shuffle of the posting table on o_custkey.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    if with_customer:
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
        j = o.join(c, o.o_custkey == c.c_custkey, "left")
    else:
        j = o.select("*", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    status = _case(F.substring("o_orderpriority", 1, 1), PRIORITY_TO_STATUS)
    title = F.concat(F.col("c_mktsegment"), F.lit(" Engineer"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("REF-"), F.col("o_orderkey").cast("string")).alias("reference_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("H-"), F.col("o_orderkey").cast("string"))).alias("hash_id"),
        title.alias("title"),
        F.col("c_name").alias("company"),
        F.concat(title, F.lit(" at "), F.col("c_name"), F.lit(" since "),
                 F.date_format("o_orderdate", "yyyy-MM-dd")).alias("description"),
        status.alias("status"),
        _case(F.col("o_orderstatus"), ORDERSTATUS_TO_PROCESSING).alias("processing_status"),
        F.when(status == "FETCHED", F.lit(None))
         .otherwise(F.pmod(F.floor("o_totalprice"), F.lit(101))).cast("int").alias("match_score"),
        F.lit(None).cast("string").alias("employer_email"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("string").alias("ai_analysis"),
        F.lit(None).cast("string").alias("portal_url"),
        F.when(status != "FETCHED", F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
            secs=((F.col("o_orderkey") % 4 * 20_000_000 + F.col("o_orderkey") % 5 * 1500) / F.lit(1_000_000))
            .cast("decimal(18,6)"))).alias("scored_at"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> application frame; (l_orderkey, l_linenumber, l_partkey,
    l_suppkey) identifies a row, (l_shipdate, ...) orders them."""
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    app_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.select(
        app_id.alias("id"),
        F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("cv_"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("cv_path"),
        F.concat(F.lit("cl_"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("letter_path"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"),
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events JOIN customer -> inbound mail (one message per event)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = e.join(c, e.user_id == c.c_custkey, "left")
    et = F.col("event_type")
    subject = _case(et, [(k, v[0]) for k, v in MAIL_SHAPES.items()], "")
    body = _case(et, [(k, v[1]) for k, v in MAIL_SHAPES.items()], "")
    sender = F.when(et == "signup", F.lit(UNKNOWN_SENDER)).otherwise(
        F.concat(F.lower("c_name"), F.lit(MAIL_DOMAIN)))
    return j.select(
        F.col("event_id").alias("message_id"),
        F.lit("inbox").alias("mailbox"),
        sender.alias("from_addr"),
        subject.alias("subject"),
        body.alias("body"),
        F.col("ts").cast("timestamp_ntz").alias("received_at"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> action log (seq = event_id, job = user_id)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    et = F.col("event_type")
    action = F.when(et == "signup",
                    F.when(F.col("value") >= SIGNUP_REJECT_FROM, "reject").otherwise("analyze"))
    for k, v in EVENT_TO_ACTION:
        action = action.when(et == k, v)
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("job_id"),
        action.alias("action"),
        F.when(et == "view", F.col("props")).alias("arg"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> service calls for the failure-rate windows."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("user_id").alias("service"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").alias("call_id"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("duration_s"),
    )


def _doc_key(key: str):
    # "text" keys are the SHA-256 of the whole text (compact join key).
    return F.sha2(F.col("text"), 256) if key == "text" else F.col(key)


def raw_postings(spark: SparkSession, sf_dir: str, key: str = "source") -> DataFrame:
    """documents -> raw feed records; key = source (repeats) or text hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return d.select(
        _doc_key(key).alias("reference_id"),
        F.lit(1).cast("long").alias("page"),
        F.col("doc_id").alias("pos"),
        F.col("doc_id"),
    )


def stored_keys(spark: SparkSession, sf_dir: str, key: str = "source") -> DataFrame:
    """Keys already stored: those of the documents that carry a label row."""
    d = table(spark, sf_dir, "documents").select("doc_id", _doc_key(key).alias("reference_id"))
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_semi").select("reference_id")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> model replies of six shapes chosen by doc_id % 6.

    The letter carries the whole document text (JSON-escaped) so reply
    parsing works on full texts.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    score = F.pmod(F.col("n_chars"), F.lit(101)).cast("string")
    # JSON string literal of the whole text: quotes and newlines are the only
    # characters needing escapes in the driver's documents.
    letter = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit('"'), F.lit('\\"')),
                                            F.lit("\n"), F.lit("\\n")), F.lit('"'))
    shape = F.pmod(F.col("doc_id"), F.lit(6))
    raw = (F.when(shape == 0, F.concat(F.lit("Here you go:\n```json\n{\"score\": "), score,
                                       F.lit(", \"letter\": "), letter,
                                       F.lit(", \"analysis\": [\"• a\", \"• b\", \"• c\"]}\n```")))
           .when(shape == 1, F.concat(F.lit("```\n{\"match_score\": "), score,
                                      F.lit(", \"coverLetter\": "), letter, F.lit("}\n```")))
           .when(shape == 2, F.concat(F.lit("{\"rating\": \""), score,
                                      F.when(F.col("n_chars") % 2 == 0, F.lit(".5")).otherwise(F.lit("")),
                                      F.lit("\", \"reasoning\": "), letter, F.lit("}")))
           .when(shape == 3, F.concat(F.lit("Sure. {\"matchScore\": "), score,
                                      F.lit(".9, \"explanation\": [\"x\", "), letter, F.lit("]} Thanks!")))
           .when(shape == 4, F.col("text"))
           .otherwise(F.concat(F.lit("  \n "), F.when(F.col("n_chars") % 2 == 0, F.lit("")).otherwise(F.col("text")))))
    return d.select(F.col("doc_id").alias("job_id"), raw.alias("raw"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> vector memory (content = id, metadata = label)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e.select(
        F.col("vec_id").alias("mem_id"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("content"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("embedding"),
        F.col("label"),
    )


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("html"))


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> raw search-feed records with the null patterns of a real
    feed (missing refnr / hashId / title / employer / location)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lang, did = F.col("lang"), F.col("doc_id").cast("string")
    return d.select(
        F.when(lang.isin("en", "fr"), F.concat(F.lit("R-"), did)).alias("refnr"),
        F.when(lang.isin("en", "de"), F.concat(F.lit("H-"), did)).alias("hashId"),
        F.when(lang != "es", F.col("source")).alias("titel"),
        F.when(lang != "de", F.concat(F.lit("Employer "), F.col("source"))).alias("arbeitgeber"),
        F.when(lang == "fr", F.lit(None)).when(lang == "es", F.lit("")).otherwise(F.upper(lang)).alias("ort"),
        F.lit(1).cast("long").alias("page"),
        F.col("doc_id").alias("pos"),
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents JOIN labels -> detail documents keyed by 'H-' || doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    q, t, did = F.col("quality"), F.col("toxic"), F.col("doc_id").cast("string")
    return j.select(
        F.concat(F.lit("H-"), did).alias("detail_key"),
        F.concat(F.lit("R-"), did).alias("refnr"),
        F.when(q == 1, F.col("text")).when(t == 1, F.lit(" ")).otherwise(F.lit("")).alias("stellenbeschreibung"),
        F.when(t == 1, F.lit(None)).otherwise(F.concat(F.lit("Develop "), F.col("source"))).alias("taetigkeit"),
        F.when(q == 0, F.lit("  ")).otherwise(F.concat(F.lit("Experience with "), F.col("lang"))).alias("anforderungen"),
        F.when(t == 1, F.concat(F.lit("https://jobs.example/"), did)).otherwise(F.lit(" ")).alias("externeUrl"),
        F.struct(
            F.when(q == 1, F.concat(F.lit("jobs"), did, F.lit("@x.example")))
             .when(t == 1, F.lit(" ")).alias("email"),
            F.struct(F.when(t == 0, F.concat(F.lit("hr"), did, F.lit("@y.example"))).otherwise(F.lit(""))
                     .alias("email")).alias("angebotskontakt"),
        ).alias("kontakt"),
    )


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> posting candidates for the constraint check (whole texts
    as titles, so long ones violate the length limit)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lang = F.col("lang")
    return d.select(
        F.col("doc_id"),
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("reference_id"),
        F.col("text").alias("title"),
        F.when(lang == "es", F.lit(None)).otherwise(F.col("source")).alias("company"),
        F.col("text").alias("description"),
        F.when(lang == "de", F.lit("ARCHIVED")).otherwise(F.lit("FETCHED")).alias("status"),
        F.lit("IDLE").alias("processing_status"),
        F.lit(None).cast("string").alias("employer_email"),
        F.lit(None).cast("string").alias("portal_url"),
    )


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory derived from the tables: a CV file per part (length
    (p_size - 1) * 1000, so size-1 parts give empty files) and a letter
    file per order that is not pending (length = floor(o_totalprice))."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    cv = p.select(F.concat(F.lit("cv_"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"),
                  ((F.col("p_size") - 1) * 1000).cast("long").alias("length"))
    cl = o.filter(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit("cl_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"),
        F.floor("o_totalprice").cast("long").alias("length"))
    return cv.unionByName(cl)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> user profiles (one per nation)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("full_name"),
                    F.when(F.col("n_regionkey") == 0, F.lit(None)).otherwise(F.lower("n_name")).alias("search_keyword"),
                    F.lit(None).cast("string").alias("system_prompt"),
                    F.lit(None).cast("string").alias("email_signature"),
                    F.when(F.col("n_regionkey") == 1, F.lit(" ")).otherwise(F.lit("llama3")).alias("ai_model"),
                    F.when(F.col("n_regionkey") == 2, F.lit(None)).otherwise(F.col("n_nationkey") + 50).cast("int")
                     .alias("min_match_score"),
                    F.lit(None).cast("int").alias("max_job_age_days"))


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> resume personas of the nation's profile."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    b = F.col("s_acctbal")
    return s.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("id"),
                    F.col("s_nationkey").cast("string").alias("profile_id"),
                    F.col("s_name").alias("persona_name"), F.lit("").alias("role"),
                    F.when(b < 0, F.lit(" ")).when(b > 5000, F.concat(F.lit("Override "), F.col("s_name")))
                     .alias("prompt_override"),
                    F.when(b < 1000, F.lit(None)).otherwise(F.concat(F.lit("cv_s"), F.col("s_suppkey").cast("string"),
                                                                    F.lit(".pdf"))).alias("cv_path"),
                    (b > 8000).alias("is_default"))


def profile_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events JOIN customer -> settings patches of the customer's nation
    profile; the event type picks the key (whole table, one patch per event)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = e.join(c, e.user_id == c.c_custkey)
    et, v = F.col("event_type"), F.col("value")
    key = (F.when(et == "click", "searchKeyword").when(et == "view", "minMatchScore")
            .when(et == "error", "maxJobAgeDays").when(et == "purchase", "aiModel").otherwise("systemPrompt"))
    val = (F.when(et == "click", F.concat(F.lit("kw"), F.col("user_id").cast("string")))
            .when(et == "view", F.floor(v).cast("string"))
            .when(et == "error", F.concat(F.lit(" "), F.floor(v).cast("string"), F.lit(" ")))
            .when(et == "purchase", F.when(v > 100, F.lit("x")).otherwise(F.lit("abc")))
            .otherwise(F.concat(F.lit("prompt "), F.col("event_id").cast("string"))))
    return j.select(F.col("event_id").alias("seq"), F.col("c_nationkey").cast("string").alias("profile_id"),
                    key.alias("key"), val.alias("value"))


def persona_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> persona creations (seq = s_suppkey), events JOIN supplier
    -> prompt updates (before or after all creations)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    pid = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    create = s.select(F.col("s_suppkey").alias("seq"), F.lit("create").alias("op"), pid("s_suppkey").alias("persona_id"),
                      F.col("s_nationkey").cast("string").alias("profile_id"),
                      F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"),
                      F.when(F.col("s_acctbal") > 5000, F.lit("Lead")).alias("role"),
                      F.lit(None).cast("string").alias("prompt"))
    upd = e.join(s, e.user_id == s.s_suppkey).select(
        # every third prompt comes before its persona is created
        F.when(F.col("event_id") % 3 == 0, -1 - F.col("event_id")).otherwise(F.lit(1 << 40) + F.col("event_id")).alias("seq"), F.lit("prompt").alias("op"), pid("s_suppkey").alias("persona_id"),
        F.lit(None).cast("string").alias("profile_id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("role"), F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("prompt"))
    return create.unionByName(upd)


def cv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> CV texts by file name (the text of a persona's CV file)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.concat(F.lit("cv_s"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("cv_path"),
                    F.col("text").alias("cv_text"))
