"""Driver tables as catalog tables. Every row of a driver table is used; nothing is generated beside them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions import text as X
from lorekeep.session import configure


def days(base: str, n: Column) -> Column:
    return F.timestamp_add("DAY", n.cast("int"), F.lit(base).cast("timestamp"))


def hours(base: str, n: Column) -> Column:
    return F.timestamp_add("HOUR", n.cast("int"), F.lit(base).cast("timestamp"))


def s(c: Column) -> Column:
    return c.cast("string")


class Views:
    """Catalog-shaped DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df

    # -- document catalog -------------------------------------------------------------------------------------

    @cached_property
    def entries(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels")
        i = F.col("doc_id")
        kind = (
            F.when(F.col("lang") == "en", "slack.thread").when(F.col("lang") == "fr", "google.meet")
            .when(F.col("lang") == "de", "google.doc").otherwise("web.page")
        )
        first = F.split_part("text", F.lit("\n"), F.lit(1))
        joined = d.join(lab, "doc_id", "left")
        return joined.select(
            i.alias("id"),
            F.concat(F.lit("doc-"), s(i)).alias("entry_uid"),
            F.col("source").alias("account_id"),
            kind.alias("source_kind"),
            F.when(kind == "slack.thread", F.concat(F.lit("C"), s(i % 40), F.lit(":"), s(i)))
            .otherwise(F.concat(F.lit("f"), s(i))).alias("source_id"),
            F.when(i % 5 != 0, F.concat(F.lit("https://example.org/d/"), s(i))).alias("source_url"),
            X.truncate_chars(first, 46).alias("title"),
            F.when(i % 7 != 0, days("2024-01-01", i % 365)).alias("source_created_at"),
            F.when(i % 3 != 0, days("2024-01-02", i % 365 + i % 11)).alias("source_updated_at"),
            hours("2025-01-01", i % 24).alias("ingested_at"),
            F.when(i % 10 == 0, "missing").when(i % 10 == 1, "fetch_failed").otherwise("present").alias("raw_status"),
            F.when(F.col("quality") == 1, "done")
            .when((F.col("quality") == 0) & (F.col("toxic") == 1), "failed")
            .when(F.col("quality") == 0, "pending")
            .when(i % 2 == 0, "skipped").otherwise("none").alias("summary_status"),
            (i % 5).cast("int").alias("summary_attempts"),
            F.concat(
                F.lit('{"channel_id":"C'), s(i % 40), F.lit('","channel_name":"room-'), s(i % 8),
                F.lit('"'),
                F.when(i % 4 == 0, F.concat(F.lit(',"transcript_url":"https://example.org/t/'), s(i), F.lit('"'))).otherwise(""),
                F.when(i % 6 == 0, F.lit(',"has_transcript":true')).otherwise(""),
                F.when(i % 9 == 0, F.concat(F.lit(',"recurring_event_id":"r'), s(i % 30), F.lit('"'))).otherwise(""),
                F.lit("}"),
            ).alias("metadata"),
        )

    @cached_property
    def sections(self) -> DataFrame:
        """Overview (first line), decisions (second line) and details (the whole text) of every document."""
        lines = F.split("text", "\n")
        d = self.table("documents").select("doc_id", "text", lines.alias("lines"))

        def sec(kind: str, origin: str, pos: int, text: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), F.lit(pos).alias("position"), text.alias("text"))

        rows = F.array(
            sec("overview", "generated", 1, F.col("lines")[0]),
            sec("decisions", "generated", 2, F.try_element_at("lines", F.lit(2))),
            sec("details", "extracted", 4, F.col("text")),
        )
        return (
            d.select("doc_id", F.explode(rows).alias("r"))
            .select(F.col("doc_id").alias("entry_id"), "r.*")
            .where(F.trim("text") != "")
            .select((F.col("entry_id") * 8 + F.col("position")).alias("id"), "entry_id", "kind", "origin", "position", "text")
        )

    @cached_property
    def summaries(self) -> DataFrame:
        lab = self.table("labels")
        d = self.table("documents").select("doc_id", "text")
        i = F.col("doc_id")
        native = F.col("toxic") == 1
        return lab.join(d, "doc_id").select(
            i.alias("entry_id"),
            F.when(native, "source_native").when(i % 3 == 0, "llm_api").when(i % 3 == 1, "llm_cli").otherwise("local_llm").alias("generator_kind"),
            F.concat(F.lit("p"), s(i % 3)).alias("provider"),
            F.concat(F.lit("m"), s(i % 4)).alias("model"),
            F.when(native, "native").when(i % 2 == 0, "default").otherwise("deep").alias("profile"),
            F.when(native, F.lit(None)).when(i % 3 == 0, "conversation-summary/v2").when(i % 3 == 1, "document-summary/v4")
            .otherwise("document-summary/v3").alias("prompt_version"),
            F.when(i % 5 == 0, "").when(i % 5 == 1, X.body_hash(F.col("text"))).when(i % 5 == 2, "b2:stale")
            .otherwise(F.concat(F.lit("legacy-"), s(i))).alias("input_hash"),
            days("2024-06-01", i % 90).alias("generated_at"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        """One account per document source, with an alias configuration derived from it."""
        src = self.table("documents").select("source").distinct()
        n = F.substring("source", 4, 9).cast("int")
        return src.select(
            F.col("source").alias("id"),
            F.when(n % 4 == 0, "slack").when(n % 4 == 1, "google").when(n % 4 == 2, "microsoft").otherwise("web").alias("kind"),
            F.when(n % 5 != 0, F.concat(F.lit("Account "), s(n))).alias("label"),
            F.when(n % 7 == 0, "disabled").when(n % 11 == 0, "needs_reauth").otherwise("active").alias("status"),
            F.concat(
                F.lit('{"aliases":{"names":['),
                F.when(n % 3 == 0, F.concat(F.lit('"Customer '), s(n), F.lit('","customer '), s(n), F.lit('"'))).otherwise(""),
                F.lit('],"emails":['),
                F.when(n % 4 == 1, F.concat(F.lit('"u'), s(n), F.lit('@example.org"'))).otherwise(""),
                F.lit(']},"extra_aliases":{"names":['),
                F.when(n % 6 == 2, F.concat(F.lit('"Customer '), s(n + 100), F.lit('"'))).otherwise(""),
                F.lit(']},"ingest_links":['),
                F.when(n % 8 == 0, F.lit('"google.doc","microsoft.file"')).when(n % 8 == 4, F.lit('"google.doc"')).otherwise(""),
                F.lit("]}"),
            ).alias("config"),
        )

    @cached_property
    def raw_objects(self) -> DataFrame:
        """One segment per line of a document, in order; the hash and size are those of the line."""
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("entry_id"), F.col("source").alias("account_id"), F.posexplode(F.split("text", "\n")).alias("seq", "payload")
        ).select(
            "entry_id", "account_id", F.lit("primary").alias("role"), F.col("seq").cast("long").alias("seq"),
            F.concat(F.lit("raw/"), s(F.col("entry_id")), F.lit("/primary."), s(F.col("seq")), F.lit(".txt")).alias("path"),
            F.sha2(F.encode("payload", "UTF-8"), 256).alias("sha256"),
            F.octet_length("payload").cast("long").alias("size"), "payload",
        )

    # -- items ------------------------------------------------------------------------------------------------

    @cached_property
    def items(self) -> DataFrame:
        o = self.table("orders")
        part = self.table("part").select("p_partkey", F.lower("p_name").alias("text"))
        n_parts = self.table("part").agg(F.count(F.lit(1)).alias("n_parts"))
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        kind = (
            F.when(F.col("o_orderpriority").startswith("1"), "action").when(F.col("o_orderpriority").startswith("2"), "question")
            .when(F.col("o_orderpriority").startswith("3"), "decision").when(F.col("o_orderpriority").startswith("4"), "resolved")
            .otherwise("accomplishment")
        )
        st = F.col("o_orderstatus")
        status = (
            F.when(kind == "action", F.when(st == "O", "open").when(st == "F", "done").otherwise("dropped"))
            .when(kind == "question", F.when(st == "O", "open").otherwise("answered"))
        )
        person = F.concat(F.lit("Customer "), s(c))
        # A one-row aggregate: the scalar number of parts.
        keyed = o.withColumn("p_partkey", k % n_parts.scalar())
        return keyed.join(part, "p_partkey").select(
            k.alias("id"),
            F.floor(k / 3).cast("long").alias("entry_id"),
            (k % 3).cast("int").alias("ordinal"),
            kind.alias("kind"),
            "text",
            status.alias("status"),
            F.when(kind.isin("action", "question"), person).alias("owner"),
            F.when(kind == "action", F.concat(F.lit("Customer "), s(c + 1))).alias("requester"),
            F.when((kind == "action") & (k % 3 != 0), F.date_add(F.to_date("o_orderdate"), 14)).alias("due"),
            F.array(person, F.concat(F.lit("clerk "), s(k % 1000))).alias("actors"),
            F.when(k % 11 != 0, F.col("o_orderdate")).alias("occurred_at"),
            F.when(k % 5 == 0, "low").when(k % 5 <= 2, "medium").otherwise("high").alias("confidence"),
            F.concat(F.lit("scope:"), s(F.floor(c / 4).cast("long"))).alias("scope_key"),
        )

    @cached_property
    def item_entries(self) -> DataFrame:
        """The entries the items belong to: three consecutive orders each."""
        e = F.floor(F.col("o_orderkey") / 3).cast("long")
        g = self.table("orders").groupBy(e.alias("id")).agg(
            F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.min("o_custkey").alias("cust")
        )
        i = F.col("id")
        return g.select(
            "id",
            F.concat(F.lit("acct"), s(F.col("cust") % 20)).alias("account_id"),
            F.when(i % 4 == 0, "slack.thread").when(i % 4 == 1, "google.meet").when(i % 4 == 2, "google.doc").otherwise("slack.day").alias("source_kind"),
            F.concat(F.lit("Entry "), s(i)).alias("title"),
            F.col("lo").alias("source_created_at"),
            F.when(i % 3 != 0, F.col("hi")).alias("source_updated_at"),
            F.lit("2002-01-01").cast("timestamp").alias("ingested_at"),
            F.when(i % 6 == 0, "pending").when(i % 6 == 1, "skipped").otherwise("done").alias("summary_status"),
        )

    @cached_property
    def item_summaries(self) -> DataFrame:
        i = F.col("id")
        return self.item_entries.where(F.col("summary_status") == "done").select(
            i.alias("entry_id"),
            F.when(i % 6 == 2, "source_native").otherwise("llm_api").alias("generator_kind"),
            F.concat(F.lit("m"), s(i % 4)).alias("model"),
            F.lit("default").alias("profile"),
            F.when(i % 6 == 2, F.lit(None)).when(i % 6 == 3, "document-summary/v3").otherwise("document-summary/v4").alias("prompt_version"),
        )

    @cached_property
    def item_links(self) -> DataFrame:
        """Every order points at a neighbour; relation and confidence come from its key."""
        o = self.table("orders")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("from_item"),
            (k - k % 7 + (k * 3) % 7).alias("to_item"),
            F.when(k % 4 == 0, "resolves").when(k % 4 == 1, "supersedes").otherwise("same_as").alias("relation"),
            F.when(k % 5 == 1, "low").when(k % 5 <= 3, "medium").otherwise("high").alias("confidence"),
        )

    # -- conversations ----------------------------------------------------------------------------------------

    @cached_property
    def message_segments(self) -> DataFrame:
        """Stored JSON lines: segment 0 holds every turn, segment 1 every third turn again with edited text."""
        c = self.table("conversations")
        conv, turn = F.col("conv_id"), F.col("turn")
        secs = F.lit(1704067200) + conv * 3600 + turn * 1500
        ts = F.concat(s(secs), F.lit("."), F.lpad(s(turn), 6, "0"))
        base = c.select(
            F.concat(F.lit("C"), s(conv % 9), F.lit(":"), s(conv)).alias("source_id"),
            F.concat(F.lit("C"), s(conv % 9)).alias("channel"),
            "conv_id", "turn", ts.alias("ts"), "role", "text",
        )
        edited = base.where(F.col("turn") % 3 == 1).withColumn("text", F.concat("text", F.lit(" (edited)")))
        both = base.withColumn("seq", F.lit(0)).unionByName(edited.withColumn("seq", F.lit(1)))
        body = F.to_json(
            F.struct(
                "ts",
                F.concat(s(F.lit(1704067200) + conv * 3600), F.lit(".000000")).alias("thread_ts"),
                F.concat(F.lit("U"), s((conv * 2 + F.when(F.col("role") == "user", 0).otherwise(1)) % 60)).alias("user"),
                "text",
                F.when(turn == 0, 1).otherwise(0).alias("reply_count"),
                F.when(turn == 5, "thread_broadcast").alias("subtype"),
            )
        )
        return both.select("source_id", "channel", "seq", "turn", body.alias("line"))

    @cached_property
    def directory(self) -> DataFrame:
        """User directory derived from the nations: some users have no display name at all."""
        n = self.table("nation")
        k = F.col("n_nationkey")
        return n.select(
            F.concat(F.lit("U"), s(k * 2)).alias("user_id"),
            F.lower("n_name").alias("name"),
            F.when(k % 3 == 0, F.initcap("n_name")).otherwise("").alias("display_name"),
            F.when(k % 2 == 0, F.concat(F.lit("Person "), F.col("n_name"))).otherwise(" ").alias("real_name"),
            (k % 5 == 0).alias("is_bot"),
        )

    @cached_property
    def link_messages(self) -> DataFrame:
        """One message per page: the page's URL in angle brackets, then two document links and a bare page URL."""
        p = self.table("pages")
        i = F.col("page_id")
        text = F.concat(
            F.lit("see <"), F.col("url"), F.lit("|the page> and https://docs.google.com/document/d/doc"), s(F.floor(i / 4).cast("long")),
            F.lit("/edit#h"), s(i), F.lit(", <https://team.sharepoint.com/s/"), s(F.floor(i / 3).cast("long")), F.lit("?e=1&amp;x=2> "),
            F.col("url"), F.lit("."),
        )
        return p.select(
            F.concat(F.lit("acct"), s(i % 6)).alias("account_id"), (F.floor(i / 2).cast("long")).alias("entry_id"),
            i.alias("message_id"),
            F.concat(s(F.lit(1704067200) + F.floor(i / 2).cast("long") * 100 + i % 2), F.lit(".000100")).alias("ts"),
            text.alias("text"),
        )

    # -- streams ----------------------------------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def ledger(self) -> DataFrame:
        """One usage row per event; every tenth row has no known cost."""
        i = F.col("event_id")
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select(
            i.alias("id"), F.date_trunc("second", "ts").alias("at"), F.col("user_id").alias("entry_id"),
            F.col("event_type").alias("model"), F.concat(F.lit("p"), s(i % 3)).alias("provider"),
            (F.lit(100) + k).alias("input_tokens"), (F.lit(10) + k % 7).alias("output_tokens"),
            (F.lit(1) + i % 3).alias("calls"), F.when(i % 10 != 0, F.col("value")).alias("cost_usd"),
        )

    # -- operational tables -----------------------------------------------------------------------------------

    @cached_property
    def runs(self) -> DataFrame:
        i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
        t = F.col("event_type")
        return self.events.select(
            i.alias("id"),
            F.when(t == "view", "sync").when(t == "click", "sync --deep").when(t == "signup", "import")
            .when(t == "error", "scan-links").otherwise("summarize").alias("command"),
            F.when(i % 3 == 0, "schedule").when(i % 3 == 1, "manual").otherwise("mcp").alias("trigger"),
            F.date_trunc("second", "ts").alias("started_at"),
            F.when(i % 13 != 0, F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.date_trunc("second", "ts"))).alias("finished_at"),
            F.when(i % 13 == 0, "running").when(i % 6 == 0, "failed").when(i % 6 == 1, "partial").when(i % 6 == 2, "interrupted").otherwise("ok").alias("status"),
            F.concat(F.lit('{"queue_remaining":'), s(k), F.lit(',"pending_summaries":'), s(k % 5), F.lit("}")).alias("stats"),
            F.when(i % 6 == 0, F.concat(F.lit("error "), s(k))).alias("error"),
            ("user_id"),
        )

    @cached_property
    def cursors(self) -> DataFrame:
        c, n = F.col("c_custkey"), F.col("c_nationkey")
        since = F.date_format(days("2023-01-01", c % 300), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        until_s = F.lit(1704067200) + (c % 500) * 3600
        value = F.concat(
            F.lit('{"oldest":"'), s(until_s), F.lit('.000000","last_activity":"'), s(until_s - (c % 90) * 86400), F.lit('.000100"'),
            F.when(c % 4 != 0, F.concat(F.lit(',"covered_since":"'), since, F.lit('"'))).otherwise(""), F.lit("}"),
        )
        return self.table("customer").select(
            F.concat(F.lit("acct"), s(n)).alias("account_id"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "google.meet").otherwise("slack.thread").alias("source_kind"),
            F.concat(F.when(c % 3 == 0, "watch:").otherwise("conv:"), F.lit("C"), s(c)).alias("key"),
            value.alias("value"),
        )

    @cached_property
    def queue(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            F.concat(F.lit("src"), s(c % 20)).alias("account_id"),
            F.when(k % 2 == 0, "slack.thread").otherwise("google.doc").alias("source_kind"),
            F.concat(F.lit("q"), s(k)).alias("source_id"),
            F.when(k % 3 == 0, "new_thread").otherwise("watched").alias("reason"),
            F.concat(F.lit('{"n":'), s(k), F.lit("}")).alias("hint"),
            F.col("o_orderdate").alias("enqueued_at"),
            (k % 7).cast("int").alias("attempts"),
            F.when(k % 7 > 3, F.concat(F.lit("timeout "), s(k))).alias("last_error"),
        )

    @cached_property
    def cache(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("acct"), s(F.col("c_nationkey"))).alias("account_id"), F.concat(F.lit("k"), s(c)).alias("key"),
            F.col("c_mktsegment").alias("value"), days("2024-01-01", c % 60).alias("expires_at"),
        )

    @cached_property
    def issues(self) -> DataFrame:
        """Issues derived from customers; a third are resolved, and the natural key is unique among the open ones."""
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.alias("id"),
            F.concat(F.lit("area"), s(c % 5), F.lit(".check")).alias("code"),
            F.when(c % 4 == 0, "error").when(c % 4 == 1, "warning").otherwise("info").alias("severity"),
            F.when(c % 6 != 0, F.concat(F.lit("acct"), s(c % 25))).alias("account_id"),
            c.alias("entry_id"),
            F.concat(F.lit("message "), s(c)).alias("message"),
            days("2024-01-01", c % 50).alias("first_seen_at"),
            days("2024-03-01", c % 50).alias("last_seen_at"),
            F.when(c % 3 == 0, days("2024-05-01", c % 50)).alias("resolved_at"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        """What a new check found: one finding per order customer, with the worst severity of its orders."""
        o = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
        c, k = F.col("o_custkey"), F.col("k")
        return o.select(
            F.concat(F.lit("area"), s(c % 5), F.lit(".check")).alias("code"),
            F.when(k % 2 == 0, "error").otherwise("warning").alias("severity"),
            F.when(c % 6 != 0, F.concat(F.lit("acct"), s(c % 25))).alias("account_id"),
            c.alias("entry_id"), F.concat(F.lit("found "), s(k)).alias("message"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """A link table: one row per line item's supplier and part, in every state."""
        li = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("seen"), F.min("l_orderkey").alias("k"))
        k, p = F.col("k"), F.col("l_partkey")
        status = (
            F.when(k % 7 <= 2, "pending").when(k % 7 == 3, "unavailable").when(k % 7 == 4, "ingested")
            .when(k % 7 == 5, "abandoned").otherwise("not_applicable")
        )
        return li.select(
            F.concat(F.lit("src"), s(F.col("l_suppkey") % 20)).alias("account_id"),
            F.concat(F.lit("key"), s(F.col("l_suppkey")), F.lit("-"), s(p)).alias("link_key"),
            F.when(p % 3 == 0, "microsoft.file").otherwise("google.doc").alias("source_kind"),
            F.concat(F.lit("https://h"), s(p % 5), F.lit(".example.org/"), s(p)).alias("url"),
            F.concat(F.lit("h"), s(p % 5), F.lit(".example.org")).alias("host"),
            F.floor(k / 3).cast("long").alias("first_entry_id"), F.col("seen").alias("first_seen_at"), status.alias("status"),
            F.when(k % 7 == 4, k).alias("entry_id"), (k % 6).cast("int").alias("attempts"),
            F.when(k % 4 != 0, F.timestamp_add("DAY", (k % 40).cast("int"), F.col("seen"))).alias("next_attempt_at"),
            F.when(k % 7 == 3, "no access").alias("last_error"),
        )

    @cached_property
    def link_outcomes(self) -> DataFrame:
        """One outcome for every link, from its key length and tries."""
        n = F.length("link_key") + F.col("attempts")
        o = F.when(n % 5 == 0, "ingested").when(n % 5 == 1, "duplicate").when(n % 5 == 2, "not_applicable").when(n % 5 == 3, "unavailable").otherwise("waiting")
        return self.links.select("account_id", "link_key", o.alias("outcome"), F.lit(7).cast("long").alias("outcome_entry"), F.concat(F.lit("e"), s(n)).alias("error"))
