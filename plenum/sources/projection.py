"""The driver's star schema seen as the platform's domain: people, paragraphs, votes, meetings, budgets, invoices.

Each relation is one lazily built DataFrame; columns that a query does not use are pruned down to the Parquet scan.  The
same relations exist as SQL in ``RELATIONS`` for checks in another engine.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"
DECISIONS = {"F": "bifall", "O": "avslag", "P": "bordläggning"}
VOTES = {"A": "ja", "R": "nej", "N": "avstår"}
EVENTS = {"view": "närvarade", "click": "talade_i", "signup": "yrkat", "purchase": "inlämnade_motion", "error": "jävsanmälan"}


def _case(column, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(column == key, F.lit(name)).otherwise(out)
    return out


class Civic:
    """Relations over the tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def people(self) -> DataFrame:
        """id, namn, parti, namnd: suppliers; the party is their nation's region."""
        nations = self.table("nation")
        return self.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("politiker-"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_name").alias("namn"),
            F.concat(F.lit("P"), F.col("n_regionkey").cast("string")).alias("parti"),
            F.concat(F.lit("nämnd-"), F.lower("n_name")).alias("namnd"),
            F.col("s_acctbal").alias("saldo"),
        )

    def paragraphs(self) -> DataFrame:
        """id, label, datum, beslut, orsak, nr, belopp, mote: orders; every fifth is the executive's (ks-)."""
        key = F.col("o_orderkey")
        day = F.date_format("o_orderdate", DAY)
        return self.table("orders").select(
            F.concat(F.when(key % 5 == 0, F.lit("ks-")).otherwise(F.lit("kf-")), key.cast("string")).alias("id"),
            F.concat(F.lit("Ärende "), key.cast("string"), F.lit(" ("), F.col("o_orderpriority"), F.lit(")")).alias("label"),
            day.alias("datum"),
            _case(F.col("o_orderstatus"), DECISIONS).alias("beslut"),
            F.col("o_orderpriority").alias("orsak"),
            F.when(key % 7 != 0, (key % 200).cast("int")).alias("nr"),
            F.col("o_totalprice").alias("belopp"),
            F.concat(F.lit("möte-"), day).alias("mote"),
            F.col("o_custkey").alias("kund"),
        )

    def votes(self) -> DataFrame:
        """from_id, to_id, rost: line items; a multigraph, rows repeat."""
        key = F.col("l_orderkey")
        return self.table("lineitem").select(
            F.concat(F.lit("politiker-"), F.col("l_suppkey").cast("string")).alias("from_id"),
            F.concat(F.when(key % 5 == 0, F.lit("ks-")).otherwise(F.lit("kf-")), key.cast("string")).alias("to_id"),
            _case(F.col("l_returnflag"), VOTES).alias("rost"),
        )

    def party_votes(self) -> DataFrame:
        """Votes with the voter's party: from_id, to_id, rost, parti."""
        people = self.people().select(F.col("id").alias("from_id"), "parti")
        return self.votes().join(people, "from_id")

    def acts(self) -> DataFrame:
        """from_id, to_id, typ, datum, arende, langd: events as edges from people to the meeting of the day."""
        day = F.date_format("ts", DAY)
        return self.table("events").select(
            F.concat(F.lit("politiker-"), F.col("user_id").cast("string")).alias("from_id"),
            F.concat(F.lit("möte-"), day).alias("to_id"),
            _case(F.col("event_type"), EVENTS).alias("typ"),
            day.alias("datum"),
            F.get_json_object("props", "$.k").cast("int").alias("arende"),
            F.floor("value").alias("langd"),
            F.col("event_id").alias("ordning"),
        )

    def nodes(self) -> DataFrame:
        """id, typ, label, datum, parti, beslut: people, paragraphs, meetings and committees."""
        none = F.lit(None).cast("string")
        people = self.people().select("id", F.lit("politiker").alias("typ"), F.col("namn").alias("label"), none.alias("datum"), "parti", none.alias("beslut"))
        paragraphs = self.paragraphs().select("id", F.lit("paragraf").alias("typ"), "label", "datum", none.alias("parti"), "beslut")
        days = self.acts().select("to_id", "datum").distinct()
        meetings = days.select(F.col("to_id").alias("id"), F.lit("möte").alias("typ"), F.concat(F.lit("Sammanträde "), "datum").alias("label"), "datum", none.alias("parti"), none.alias("beslut"))
        committees = self.table("nation").select(F.concat(F.lit("nämnd-"), F.lower("n_name")).alias("id"), F.lit("organisation").alias("typ"), F.col("n_name").alias("label"), none.alias("datum"), none.alias("parti"), none.alias("beslut"))
        return people.unionByName(paragraphs).unionByName(meetings).unionByName(committees)

    def edges(self) -> DataFrame:
        """from_id, to_id, typ, label: votes, acts and committee seats."""
        none = F.lit(None).cast("string")
        votes = self.votes().select("from_id", "to_id", F.concat(F.lit("röstade_"), "rost").alias("typ"), none.alias("label"))
        acts = self.acts().select("from_id", "to_id", "typ", F.col("arende").cast("string").alias("label"))
        seats = self.people().select(F.col("id").alias("from_id"), F.col("namnd").alias("to_id"), F.lit("ledamot_i").alias("typ"), F.when(F.col("saldo") < 0, "Ersättare").otherwise("Ledamot").alias("label"))
        return votes.unionByName(acts).unionByName(seats)

    def graph_rows(self) -> int:
        """How many edges and nodes there are, about: the rows of the tables that they are made of, by the files' footers."""
        return sum(self.table(t).count() for t in ("lineitem", "events", "orders", "supplier"))

    def invoices(self) -> DataFrame:
        """namnd, leverantor, orgnr, konto, belopp, ar, manad: line items of a supplier, by account and month."""
        people = self.table("supplier").select("s_suppkey", F.col("s_name").alias("leverantor"), F.col("s_nationkey"))
        parts = self.table("part").select("p_partkey", F.col("p_type").alias("konto"))
        return (
            self.table("lineitem").join(people, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat(F.lit("nämnd-nation_"), F.col("s_nationkey").cast("string")).alias("namnd"), "leverantor",
                F.concat(F.lit("556000-"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("orgnr"), "konto",
                F.col("l_extendedprice").alias("belopp"), F.year("l_shipdate").alias("ar"), F.month("l_shipdate").alias("manad"),
            )
        )

    def grants(self) -> DataFrame:
        """namnd, ar, mnkr: orders of the committee's nation by year, in millions."""
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.concat(F.lit("nämnd-nation_"), F.col("c_nationkey").cast("string")).alias("namnd"), F.year("o_orderdate").alias("ar"))
            .agg((F.floor(F.sum("o_totalprice") / 1e4 + 0.5) / 100).alias("mnkr"))
        )

    def speeches(self) -> DataFrame:
        """key, datum, arende, talare, langd: turns of conversations; ten conversations make a day."""
        return self.table("conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("key"),
            F.floor(F.col("conv_id") / 10).cast("string").alias("datum"),
            F.col("conv_id").cast("string").alias("arende"),
            F.col("role").alias("talare"),
            F.coalesce(F.length("text"), F.lit(0)).alias("langd"),
        )


#: The same relations in SQL that DuckDB runs; a query's SQL is these and its own SELECT.
RELATIONS = """
people AS (
  SELECT 'politiker-' || s_suppkey AS id, s_name AS namn, 'P' || n_regionkey AS parti, 'nämnd-' || lower(n_name) AS namnd, s_acctbal AS saldo
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), paragraphs AS (
  SELECT (CASE WHEN o_orderkey % 5 = 0 THEN 'ks-' ELSE 'kf-' END) || o_orderkey AS id,
         'Ärende ' || o_orderkey || ' (' || o_orderpriority || ')' AS label, strftime(o_orderdate, '%Y-%m-%d') AS datum,
         CASE o_orderstatus WHEN 'F' THEN 'bifall' WHEN 'O' THEN 'avslag' WHEN 'P' THEN 'bordläggning' END AS beslut,
         o_orderpriority AS orsak, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 200)::INT END AS nr, o_totalprice AS belopp,
         'möte-' || strftime(o_orderdate, '%Y-%m-%d') AS mote, o_custkey AS kund
  FROM orders
), votes AS (
  SELECT 'politiker-' || l_suppkey AS from_id, (CASE WHEN l_orderkey % 5 = 0 THEN 'ks-' ELSE 'kf-' END) || l_orderkey AS to_id,
         CASE l_returnflag WHEN 'A' THEN 'ja' WHEN 'R' THEN 'nej' WHEN 'N' THEN 'avstår' END AS rost
  FROM lineitem
), party_votes AS (
  SELECT v.*, p.parti FROM votes v JOIN people p ON v.from_id = p.id
), acts AS (
  SELECT 'politiker-' || user_id AS from_id, 'möte-' || strftime(ts, '%Y-%m-%d') AS to_id,
         CASE event_type WHEN 'view' THEN 'närvarade' WHEN 'click' THEN 'talade_i' WHEN 'signup' THEN 'yrkat'
           WHEN 'purchase' THEN 'inlämnade_motion' WHEN 'error' THEN 'jävsanmälan' END AS typ,
         strftime(ts, '%Y-%m-%d') AS datum, json_extract_string(props, '$.k')::INT AS arende, floor(value)::BIGINT AS langd, event_id AS ordning
  FROM events
), nodes AS (
  SELECT id, 'politiker' AS typ, namn AS label, NULL::VARCHAR AS datum, parti, NULL::VARCHAR AS beslut FROM people
  UNION ALL SELECT id, 'paragraf', label, datum, NULL, beslut FROM paragraphs
  UNION ALL SELECT DISTINCT to_id, 'möte', 'Sammanträde ' || datum, datum, NULL, NULL FROM acts
  UNION ALL SELECT 'nämnd-' || lower(n_name), 'organisation', n_name, NULL, NULL, NULL FROM nation
), edges AS (
  SELECT from_id, to_id, 'röstade_' || rost AS typ, NULL::VARCHAR AS label FROM votes
  UNION ALL SELECT from_id, to_id, typ, arende::VARCHAR FROM acts
  UNION ALL SELECT id, namnd, 'ledamot_i', CASE WHEN saldo < 0 THEN 'Ersättare' ELSE 'Ledamot' END FROM people
), invoices AS (
  SELECT 'nämnd-nation_' || s_nationkey AS namnd, s_name AS leverantor, '556000-' || lpad(s_suppkey::VARCHAR, 4, '0') AS orgnr, p_type AS konto,
         l_extendedprice AS belopp, year(l_shipdate)::INT AS ar, month(l_shipdate)::INT AS manad
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
), grants AS (
  SELECT 'nämnd-nation_' || c_nationkey AS namnd, year(o_orderdate)::INT AS ar, floor(sum(o_totalprice) / 1e4 + 0.5) / 100 AS mnkr
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), speeches AS (
  SELECT conv_id || '-' || turn AS key, (conv_id // 10)::VARCHAR AS datum, conv_id::VARCHAR AS arende, role AS talare, coalesce(length(text), 0)::INT AS langd
  FROM conversations
)
"""


def sql(select: str) -> str:
    return f"WITH {RELATIONS}\n{select}"
