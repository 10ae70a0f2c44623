"""A web archive's index and snapshots: who was listed when, terms of office, and what was known on a day."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators import html as H

# An id in an address, a person's link of the older pages, and party names with their codes.
ID = r"/(?:person|organisation)/([^/?#\s]+)"
OLD_LINK = r"viewPerson[^\"]*id=(\d+)[^\"]*\"[^>]*>\s*([^<]+)"
PARTY_CODES = {
    "socialdemokraterna": "S", "moderaterna": "M", "vänsterpartiet": "V", "sverigedemokraterna": "SD", "liberalerna": "L", "miljöpartiet": "MP",
    "miljöpartiet de gröna": "MP", "demokraterna": "D", "kristdemokraterna": "KD", "centerpartiet": "C", "opolitisk": "-",
}
#: Length of the pieces of time in which events meet snapshots.
PIECE_SECONDS = 86_400


def archive_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """url, tid, id of index lines ``<url> <yyyyMMddHHmmss>``; other lines give no rows, equal ones one.

    ``id`` is the organisation's or person's in the address, or null.
    """
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.select(F.get(parts, 0).alias("url"), F.get(parts, 1).alias("t")).filter(F.col("t").rlike(r"^\d{14}$"))
    rows = rows.select("url", F.try_to_timestamp("t", F.lit("yyyyMMddHHmmss")).alias("tid"), F.nullif(F.regexp_extract("url", ID, 1), F.lit("")).alias("id"))
    return rows.filter("tid is not null").distinct()


def party_code(name: Column) -> Column:
    """A party's code; a name that is not known stays, nothing is '-'."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for pair in PARTY_CODES.items() for x in pair]), F.lower(F.trim(name)))
    return F.coalesce(code, F.nullif(F.trim(name), F.lit("")), F.lit("-"))


def listed(snapshots: DataFrame) -> DataFrame:
    """Members on archived organisation pages (id, tid, html): organ, tid, rad, person, fornamn, efternamn, parti, roll."""
    found = H.members(snapshots.select(F.col("id").alias("organ"), "tid", "html"))
    return found.select("organ", "tid", "rad", F.col("id").alias("person"), "fornamn", "efternamn", party_code(F.col("parti")).alias("parti"), "roll")


def accumulated(seen: DataFrame) -> DataFrame:
    """A row per person: name and party as first seen, all roles in order, first and last time seen."""
    first = lambda c: F.min_by(c, F.struct("tid", "organ", "rad")).alias(c)
    roles = F.array_sort(F.collect_set(F.nullif("roll", F.lit("")))).alias("roller")
    return seen.groupBy("person").agg(first("fornamn"), first("efternamn"), first("parti"), roles, F.min("tid").alias("forst"), F.max("tid").alias("sist"))


def departed(seen: DataFrame, roster: DataFrame, person_pages: DataFrame) -> DataFrame:
    """People of the archive that the present roster (id) lacks, with what their archived page (id, html) says of them.

    person, fornamn, efternamn, parti, roller, epost, uppdrag (a list, empty without a page).
    """
    gone = accumulated(seen).join(roster.select(F.col("id").alias("person")), "person", "left_anti")
    pages = person_pages.select(F.col("id").alias("person"), "html").join(gone.select("person"), "person", "left_semi")
    held = H.assignments(pages).groupBy("person").agg(F.array_sort(F.collect_list(F.struct("rad", "organisation", "organisation_id", "roll", "fran", "till"))).alias("u"))
    held = held.select("person", F.transform("u", lambda x: x.dropFields("rad")).alias("uppdrag"))
    out = gone.join(held, "person", "left").join(H.emails(pages, "person"), "person", "left")
    none = F.array().cast(dict(held.dtypes)["uppdrag"])
    return out.select("person", "fornamn", "efternamn", "parti", "roller", "epost", F.coalesce("uppdrag", none).alias("uppdrag"))


def terms(seen: DataFrame, snapshots: DataFrame) -> DataFrame:
    """organ, person, fran, till: unbroken presence over an organisation's snapshots (id, tid).

    A term begins with the first snapshot that lists the person and ends with the first after it that does not; it is open (null)
    if none follows.  Snapshots without any member count as well: they end all terms.
    """
    of_organ = Window.partitionBy("organ").orderBy("tid")  # as many rows as an organisation has snapshots
    times = snapshots.select(F.col("id").alias("organ"), "tid").distinct()
    times = times.select("organ", "tid", F.row_number().over(of_organ).alias("nr"), F.lead("tid").over(of_organ).alias("nasta"))
    there = seen.select("organ", "person", "tid").distinct().join(times, ["organ", "tid"])
    island = F.col("nr") - F.row_number().over(Window.partitionBy("organ", "person").orderBy("nr"))
    spans = there.withColumn("o", island).groupBy("organ", "person", "o").agg(F.min("tid").alias("fran"), F.max_by("nasta", "nr").alias("till"))
    return spans.select("organ", "person", "fran", "till")


def as_of(events: DataFrame, snapshots: DataFrame, key: str, when: str, since: str, value: str) -> DataFrame:
    """``events`` with ``value`` of the latest of the key's snapshots at or before each event; null before the first.

    A snapshot holds until the next one of its key.  That time is cut into pieces, which events meet by an equi-join, so the events of
    a frequent key are in no window and Spark may split them.  Of snapshots at one time the greatest value counts.
    """
    piece = lambda t: F.floor(F.unix_seconds(t) / PIECE_SECONDS)
    latest = events.agg(F.max(piece(F.col(when))).alias("_last"))
    each = snapshots.groupBy(key, F.col(since).alias("_since")).agg(F.max(value).alias("_value"))
    each = each.withColumn("_until", F.lead("_since").over(Window.partitionBy(key).orderBy("_since"))).join(F.broadcast(latest))
    begin, end = piece(F.col("_since")), F.coalesce(piece(F.col("_until")), F.col("_last"))
    pieces = each.filter(end >= begin).select(key, "_since", "_until", "_value", F.explode(F.sequence(begin, end)).alias("_piece"))
    rows = events.withColumn("_piece", piece(F.col(when)))
    met = [rows[key] == pieces[key], rows["_piece"] == pieces["_piece"], rows[when] >= pieces["_since"], pieces["_until"].isNull() | (rows[when] < pieces["_until"])]
    return rows.join(pieces, met, "left").select(*[rows[c] for c in events.columns], pieces["_value"].alias(value))


def old_names(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, namn: people on pages of the older form, where a person has two links, the last name's and the first name's.

    Names are in lower case, composed, with single spaces.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(OLD_LINK), 1).alias("id"), F.regexp_extract_all(html, F.lit(OLD_LINK), 2).alias("del"))
    rows = pages.select(key, F.posexplode(pairs).alias("p", "x")).select(key, "p", "x.id", F.trim("x.del").alias("del"))
    parts = rows.groupBy(key, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "del"))), lambda x: x["del"]).alias("d")).filter(F.size("d") >= 2)
    name = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", F.get("d", 1), F.get("d", 0))), r"\s+", " "))
    return parts.select(key, name.alias("namn")).distinct()


def added_periods(roster: DataFrame, seen: DataFrame) -> DataFrame:
    """id, period that the roster (id, fornamn, efternamn, perioder) lacks and in which its name was seen (period, namn)."""
    name = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "fornamn", "efternamn")), r"\s+", " "))
    rows = roster.select("id", name.alias("namn"), F.coalesce("perioder", F.array().cast("array<string>")).alias("perioder"))
    return rows.join(seen.select("period", "namn").distinct(), "namn").filter(~F.array_contains("perioder", F.col("period"))).select("id", "period")
