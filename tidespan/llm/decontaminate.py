"""Benchmark decontamination (native): template windows, hash join, slot consistency.

Texts become templates: a number is ``<num>``, a word with a capital and small letters after it is
``<name>``, a unit next to a number is ``<unit>``; other words lose case and punctuation. Windows
of five template words are hashed and joined with those of the benchmark. For each item, document
and alignment (offset of document words against item words) the slots are compared: each slot
value of the item must stand for one value in the document. Windows of consistent alignments
count; a document is contaminated by an item if they cover 80 % of the item's windows. So a copied
question and one with other numbers or names are both found, a document that only shares the
shape of a sentence here and there is not.

Pairs of a document and an item are formed from rare windows only: who covers 80 % of an item's
windows covers at least one of its rarest 20 % and one more, by counts over all documents. So a
window that stands in all documents and many items makes no pairs; all windows are then counted
for the pairs that are left.

With ``any_case``, as ``drop_contaminated`` has it, each window has a second hash, of its words in
small letters without punctuation, and a position counts as covered if either hash aligns: copies
in all small or all capital letters have no names that templates could show.

Defined results: null and blank texts and items of fewer than five template words match nothing;
rows equal in id and text are one document; repeated items of the same id are one item with
pooled windows; null ids match like values; input columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK_RE, WORD_BREAKS, join_spread, let, materialize, small_enough

WINDOW = 5
MIN_SHARE = 0.8

# Units of measure, as they are written beside numbers.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr ms kmh mph km/h m/s v w kw kwh a hz khz mhz ghz kb mb gb tb j kj cal kcal pa bar "
    "usd eur gbp dollars dollar euros euro cents cent pounds pound meters meter metres metre kilometers kilometer kilometres kilometre miles mile feet foot inches inch "
    "grams gram kilograms kilogram liters liter litres litre seconds second minutes minute hours hour days day weeks week months month years year percent degrees degree"
).split()

#: (pattern, replacement); both engines' regular expressions agree on these.
PASSES = (
    (r"(^|[^\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}]*", r"\1<name>"),
    (r"[0-9]+([.,:/][0-9]+)*", "<num>"),
    (r"[^\p{L}\p{N}<>/ ]+", ""),
)
UNIT_PASS = (rf"<num>( ?)({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})( |$)", r"<num>\1<unit>\3")


def _spaced(text: Column) -> Column:
    """The words with one space between."""
    return F.regexp_replace(F.btrim(text, F.lit(WORD_BREAKS)), WORD_BREAK_RE, " ")


def _template(spaced: Column) -> Column:
    """Template words, one for each word of ``spaced``; a word of punctuation only becomes ''."""
    java = lambda r: r.replace("\\1", "$1").replace("\\3", "$3")
    for pattern, to in PASSES:
        spaced = F.regexp_replace(spaced, pattern, java(to))
    return F.split(F.regexp_replace(F.lower(spaced), UNIT_PASS[0], java(UNIT_PASS[1])), " ")


def _windows(words: Column) -> Column:
    """The hash of each window of template words."""
    at = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    return let(words, lambda w: F.when(F.size(w) >= WINDOW, at(w)).otherwise(F.array().cast("array<bigint>")))


def _any_case_windows(spaced: Column) -> Column:
    """(p, g): position and hash of each window, of its template words and of its plain words."""
    plain = F.split(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N} ]+", "")), " ")
    pair = F.filter(F.arrays_zip(_template(spaced).alias("t"), plain.alias("w")), lambda x: x["t"] != "")
    entry = lambda i, *words: F.struct(i.alias("p"), F.xxhash64(*words).alias("g"))
    both = lambda x, i: F.array(entry(i, *[x[i + k]["t"] for k in range(WINDOW)]), entry(i, F.lit("plain"), *[x[i + k]["w"] for k in range(WINDOW)]))
    at = lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x) - WINDOW), lambda i: both(x, i)))
    return let(pair, lambda x: F.when(F.size(x) >= WINDOW, at(x)))


def _grams(df: DataFrame, keys: list[str], at: str, any_case: bool) -> DataFrame:
    """The keys with position and hash of every window."""
    if any_case:
        return df.select(*keys, F.explode(_any_case_windows(F.col("s"))).alias("x")).select(*keys, F.col("x.p").alias(at), F.col("x.g").alias("g"))
    return df.select(*keys, F.posexplode(_windows(F.array_remove(_template(F.col("s")), ""))).alias(at, "g"))


def _words(spaced: Column) -> Column:
    """(position, template word, word) of every template word that is not ''."""
    pair = F.filter(F.arrays_zip(_template(spaced).alias("t"), F.split(spaced, " ").alias("w")), lambda x: x["t"] != "")
    plain = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.transform(pair, lambda x, i: F.struct(i.alias("pos"), x["t"].alias("t"), plain(x["w"]).alias("w")))


def _keyed(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(name), F.xxhash64(F.col(text_col)).alias("h"), _spaced(F.col(text_col)).alias("s"))


def _rarest(grams: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """item_id, g: windows of each item, the rarest first, so many that no document can miss them all and still cover MIN_SHARE."""
    often = grams.join(counts, "g", "left").groupBy("item_id", "ip").agg(F.sum(F.coalesce("n", F.lit(0))).alias("often"))
    placed = often.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("often", "ip")))
    size = sizes.withColumnRenamed("item_id", "i")
    few = placed.join(size, F.col("item_id").eqNullSafe(F.col("i"))).where(F.col("k") <= F.col("n_windows") - F.ceil(MIN_SHARE * F.col("n_windows") - 1e-9) + 1)
    few = few.select(F.col("item_id").alias("r_item"), F.col("ip").alias("r_ip"))
    return grams.join(few, F.col("item_id").eqNullSafe(F.col("r_item")) & (F.col("ip") == F.col("r_ip"))).select("item_id", "g").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", any_case: bool = False) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows (of the item), n_matched: one row for each contaminated document and item."""
    items = _keyed(benchmark, item_col, item_text_col, "item_id")
    grams = materialize(_grams(items, ["item_id"], "ip", any_case).distinct(), "bench-windows")
    sizes = grams.groupBy("item_id").agg(F.countDistinct("ip").alias("n_windows"))
    keys = grams.select("g").distinct()
    if small_enough(keys):
        keys = F.broadcast(keys)
    texts = _keyed(docs, id_col, text_col, "doc_id")
    found = _grams(texts, ["doc_id", "h"], "dp", any_case).join(keys, "g", "left_semi")
    # few windows of the corpus are the benchmark's; they are stored and counted
    found = materialize(found, "bench-hits")
    counts = materialize(found.groupBy("g").agg(F.count("*").alias("n")), "bench-counts")
    rare = _rarest(grams, counts, sizes)
    share = lambda n: F.col(n) >= MIN_SHARE * F.col("n_windows")
    pair = ["doc_id", "h", "item_id"]
    met = join_spread(found, rare, "g", counts).select(*[F.col(n).alias(f"m_{n}") for n in pair]).distinct()
    met = materialize(met, "bench-pairs")
    hits = met.join(found, F.col("m_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("m_h") == F.col("h"))).select(*pair[:2], F.col("m_item_id").alias("item_id"), "dp", "g")
    each = grams.select(F.col("item_id").alias("i"), "ip", F.col("g").alias("i_g"))
    match = hits.join(each, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("g") == F.col("i_g"))).select(*pair, "ip", "dp").distinct()
    match = materialize(match, "bench-matches")
    covered = match.groupBy(*pair).agg(F.countDistinct("ip").alias("n"))
    covered = covered.join(sizes.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))).where(share("n")).select(*pair, "n_windows")
    covered = materialize(covered, "bench-candidates")
    c = covered.select(*[F.col(n).alias(f"c_{n}") for n in pair], "n_windows")
    near = match.join(c, [match[n].eqNullSafe(c[f"c_{n}"]) for n in pair]).select(*pair, "n_windows", "ip", (F.col("dp") - F.col("ip")).alias("shift"))
    near = materialize(near, "bench-near")
    # the slots of each alignment: item value against document value
    whole = texts.join(c.select("c_doc_id", "c_h").distinct(), F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("h") == F.col("c_h")), "left_semi")
    said = whole.distinct().select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), F.explode(_words(F.col("s"))).alias("x")).select("d_id", "d_h", F.col("x.pos").alias("d_pos"), F.col("x.w").alias("d_w"))
    asked = items.select(F.col("item_id").alias("i_id"), F.explode(_words(F.col("s"))).alias("x")).select("i_id", F.col("x.pos").alias("i_pos"), F.col("x.w").alias("i_w"), F.col("x.t").alias("t"))
    asked = asked.where(F.col("t").rlike("<(num|name|unit)>")).drop("t").distinct()
    run = [*pair, "shift"]
    slots = near.select(*run, F.explode(F.sequence(F.col("ip"), F.col("ip") + WINDOW - 1)).alias("at")).distinct()
    slots = slots.join(asked, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("at") == F.col("i_pos")))
    slots = slots.join(said, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")) & (F.col("at") + F.col("shift") == F.col("d_pos")))
    clash = slots.groupBy(*run, "i_w").agg(F.countDistinct("d_w").alias("n")).where("n > 1").select(*[F.col(n).alias(f"k_{n}") for n in run]).distinct()
    good = near.join(clash, [near[n].eqNullSafe(clash[f"k_{n}"]) for n in run], "left_anti")
    out = good.groupBy(*pair, "n_windows").agg(F.countDistinct("ip").alias("n_matched")).where(share("n_matched"))
    return out.select("doc_id", F.col("h").alias("text_hash"), "item_id", "n_windows", "n_matched")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that no benchmark item contaminates."""
    bad = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col, any_case=True).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_h")).distinct()
    bad = materialize(bad, "bench-bad")
    if small_enough(bad):
        bad = F.broadcast(bad)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__h"))
    return rows.join(bad, F.col("__id").eqNullSafe(F.col("__bad_id")) & (F.col("__h") == F.col("__bad_h")), "left_anti").select("__row.*")


def oracle_sql() -> str:
    """The same in DuckDB, for tables ``documents`` and ``benchmark``; windows are compared as text."""

    def template(x: str) -> str:
        for pattern, to in PASSES:
            x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
        return f"string_split(regexp_replace(lower({x}), '{UNIT_PASS[0]}', '{UNIT_PASS[1]}', 'g'), ' ')"

    spaced = r"regexp_replace(regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')"
    plain = r"lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"

    def words(source: str, key: str) -> str:
        return f"""
        SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS pos, t, {plain} AS w
        FROM (SELECT {key}, unnest({template("s")}) AS t, unnest(string_split(s, ' ')) AS w, unnest(range(len(string_split(s, ' ')))) AS k
              FROM (SELECT DISTINCT {key}, s FROM (SELECT *, {spaced} AS s FROM {source} WHERE text IS NOT NULL)))
        WHERE t <> ''"""

    def windows(source: str, key: str) -> str:
        nexts = " || ' ' || ".join(f"lead(t, {k}) OVER (PARTITION BY {key} ORDER BY pos)" if k else "t" for k in range(WINDOW))
        return f"SELECT * FROM (SELECT {key}, pos, {nexts} AS g FROM {source}) WHERE g IS NOT NULL"

    return f"""
    WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "item_id")}),
    dw AS ({windows("d", "doc_id")}), bw AS ({windows("b", "item_id")}),
    sizes AS (SELECT item_id, count(*) AS n_windows FROM bw GROUP BY item_id),
    m AS (SELECT doc_id, item_id, bw.pos AS ip, dw.pos - bw.pos AS shift FROM dw JOIN bw USING (g)),
    slots AS (SELECT DISTINCT m.doc_id, m.item_id, m.shift, b.w AS i_w, d.w AS d_w
        FROM m JOIN b ON b.item_id = m.item_id AND b.pos BETWEEN m.ip AND m.ip + {WINDOW - 1} AND regexp_matches(b.t, '<(num|name|unit)>')
        JOIN d ON d.doc_id = m.doc_id AND d.pos = b.pos + m.shift),
    clash AS (SELECT doc_id, item_id, shift FROM slots GROUP BY doc_id, item_id, shift, i_w HAVING count(*) > 1),
    good AS (SELECT * FROM m ANTI JOIN clash USING (doc_id, item_id, shift))
    SELECT doc_id, item_id, n_windows, count(DISTINCT ip) AS n_matched
    FROM good JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n_windows
    HAVING count(DISTINCT ip) >= {MIN_SHARE} * n_windows
    """
