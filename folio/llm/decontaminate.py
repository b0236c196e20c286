"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text's words and numbers become template tokens: a number is <n>, a unit of measure behind a number <u>,
a name <a>, any other word itself in lower case (a literal). A name is a capitalised word, but at the start of a sentence none of FIRST_WORDS; several
names in a row are one, told by its first word. Windows of WINDOW template tokens of the benchmark that have a literal are joined by hash
with all windows of the documents. A document leaks an item if windows that cover enough of the item occur in it and,
on an alignment that has them, the placeholders' values map one to one: the same value in the item is the same value in
the document and the other way round. Each alignment (place in the document less place in the item) is
tested on its own, so one instance of a template doesn't hide another. So a question with other numbers, names or units is found,
and a text that merely has the same shape isn't.

An item of fewer than WINDOW tokens is one window. An item of fewer than LITERALS literals says too little for that: it leaks only into a
document that has its template and values and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import documents, materialize

WINDOW = 8
#: Share of an item's windows that must occur.
COVERAGE = 0.5
#: Items of fewer literals leak only as whole documents.
LITERALS = 3
#: Distinct window hashes (8 bytes each) that are broadcast at most; with more, the join shuffles.
BROADCAST_HASHES = 1_000_000
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs oz ounce ounces gram grams kilogram kilograms pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres dollar dollars cent cents euro euros percent degree degrees watt watts volt volts"
).split()
#: Words that begin sentences and aren't names.
FIRST_WORDS = (
    "a an the this that these those there here it its he she they we you i his her their our your my one two three some any all each every both many most no not "
    "in on at by to of for from with without after before during while when where why who whom whose which what how if then so but and or as because since until although "
    "is are was were do does did has have had can could will would shall should may might must let find give given suppose assume consider calculate compute determine "
    "solve write show prove use choose answer question explain describe name list true false yes"
).split()
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]"
NAME = r"^\p{Lu}\p{M}*\p{Ll}"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and uses it in body under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def template(text: str) -> str:
    """SQL of the array of (c, v) of a text column: template tokens, and the values of those that are placeholders."""
    marks = "'.', '!', '?', char(10)"
    digit = "ascii({0}) between 48 and 57"

    def name(i: str) -> str:
        begins = f"({i} = 0 or t[{i} - 1] in ({marks}))"
        return f"not ascii(t[{i}]) between 97 and 122 and t[{i}] rlike '{NAME}' and not ({begins} and lower(t[{i}]) in ({_quoted(FIRST_WORDS)}))"

    token = f"""case
        when {digit.format("x")} then struct('<n>' as c, x as v)
        when x in ({marks}) then struct(cast(null as string) as c, cast(null as string) as v)
        when i > 0 and {digit.format("t[i - 1]")} and lower(x) in ({_quoted(UNITS)}) then struct('<u>' as c, lower(x) as v)
        when {name("i")} then case when i > 0 and {name("i - 1")} then struct(cast(null as string) as c, cast(null as string) as v) else struct('<a>' as c, lower(x) as v) end
        else struct(lower(x) as c, cast(null as string) as v) end"""
    found = f"filter(transform(t, (x, i) -> {token}), y -> y.c is not null)"
    return _let("t", f"regexp_extract_all(coalesce({text}, ''), '{TOKEN}', 0)", found).replace("\\", "\\\\")


def _windows(rows: DataFrame, id_col: str, text_col: str, parts: list[str]) -> DataFrame:
    """(id, pos, h, s, whole): what the parts, SQL over h and v of each text, make."""
    literals = "size(filter(v, z -> z is null))"
    made = _let("y", template(f"`{text_col}`"), _let("h", "transform(y.c, z -> xxhash64(z))", _let("v", "y.v", _let("l", literals, f"concat({', '.join(parts)})"))))
    return rows.select(F.col(id_col), F.explode(F.expr(made)).alias("w")).select(id_col, "w.pos", "w.h", "w.s", "w.whole")


_NONE = "cast(array() as array<struct<pos: int, h: bigint, s: array<string>, whole: boolean>>)"
_WHOLE = "array(struct(1 as pos, xxhash64(h, 'whole') as h, v as s, true as whole))"


def _taken(n: int | str) -> str:
    """SQL of the windows of n tokens that have a literal."""
    found = f"transform(sequence(1, size(h) - {n} + 1), i -> struct(i as pos, xxhash64(slice(h, i, {n})) as h, slice(v, i, {n}) as s, false as whole))"
    return f"filter({found}, w -> exists(w.s, z -> z is null))"


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, h, s, whole): each window's first token, hash, and values of its placeholders (null: a literal). Texts without a word or number have none."""
    own = f"case when size(h) = 0 then {_NONE} when l < {LITERALS} then {_WHOLE} when size(h) < {WINDOW} then {_taken('size(h)')} else {_taken(WINDOW)} end"
    return _windows(items, id_col, text_col, [own])


def document_windows(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], whole: bool) -> DataFrame:
    """The same of documents: windows of each of these sizes, and with whole one of all tokens."""
    parts = [f"case when size(h) >= {n} then {_taken(n)} else {_NONE} end" for n in sizes]
    return _windows(docs, id_col, text_col, parts + [f"case when size(h) > 0 then {_WHOLE} else {_NONE} end"] * whole)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, item, windows, matched, coverage, slots, changed), one row for each leaked item of a document.

    windows: of the item; matched: those of them in the document; slots: different placeholder values held
    against each other on the alignment with most windows that qualifies (the first of those); changed: those that differ. Rows with null ids, and items with
    null ids or texts or without a word or number are left out. Repeated rows count once; rows that share an id are one document. All
    windows of a document count, however many there are.
    """
    doc, item = F.col(id_col).alias("doc"), F.col(item_col).alias("item")
    items = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(item, F.col(item_text_col).alias("item_text"))
    bench = materialize(item_windows(items, "item", "item_text").distinct(), "windows")
    short = [n for (n,) in bench.where(~F.col("whole")).select(F.size("s")).where(F.size("s") < WINDOW).distinct().collect()]  # fewer than WINDOW
    whole = bool(bench.where("whole").take(1))
    hashes = bench.select("h").distinct()
    if hashes.count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    rows = docs.where(F.col(id_col).isNotNull()).select(doc, F.col(text_col).alias("doc_text"))
    hits = document_windows(rows, "doc", "doc_text", [WINDOW, *sorted(short)], whole).drop("whole").join(hashes, "h", "left_semi")
    hits = materialize(hits.distinct(), "hits")
    # coverage needs a window of a document once, however often it occurs there; only what is covered meets its places
    totals = bench.groupBy("item").agg(F.countDistinct("pos").alias("windows"), F.max("whole").alias("whole"))
    held = bench.groupBy("item", "h").agg(F.countDistinct("pos").alias("n"))
    covered = hits.select("doc", "h").distinct().join(held, "h").groupBy("doc", "item").agg(F.sum("n").alias("matched")).join(totals, "item")
    covered = materialize(covered.where(F.col("matched") >= coverage * F.col("windows")), "covered")
    width = F.greatest(F.lit(1), F.floor(F.col("windows") / 4))
    places = bench.select("h", "item", F.col("pos").alias("at"), F.col("s").alias("value"))
    lined = hits.join(covered.select("doc", "item", width.alias("width")), "doc").join(places, ["h", "item"]).withColumn("shift", F.col("pos") - F.col("at"))
    # slots on each alignment; its windows are counted with those of alignments up to a quarter or half of the item away
    lined = lined.withColumn("bin", F.floor(F.col("shift") / F.col("width")))
    around = lined.select("doc", "item", "at", F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])).alias("bin"))
    around = around.groupBy("doc", "item", "bin").agg(F.countDistinct("at").alias("near"))
    shifts = lined.groupBy("doc", "item", "shift", "bin").agg(F.countDistinct("at").alias("n"))
    zipped = F.expr("filter(arrays_zip(value, s), z -> z.value is not null)")
    slots = lined.select("doc", "item", "shift", F.explode(zipped).alias("z"))
    slots = slots.select("doc", "item", "shift", F.col("z.value").alias("a"), F.col("z.s").alias("b")).distinct()
    found = slots.groupBy("doc", "item", "shift").agg(F.countDistinct("a").alias("left"), F.countDistinct("b").alias("right"), F.count("*").alias("slots"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("changed"))
    shifts = shifts.join(found, ["doc", "item", "shift"], "left").join(around, ["doc", "item", "bin"])
    shifts = shifts.where("slots is null or (slots = `left` and slots = `right`)")
    leaks = covered.join(shifts, ["doc", "item"]).where((F.col("near") >= coverage * F.col("windows")) & (~F.col("whole") | (F.coalesce("changed", F.lit(0)) == 0)))
    leaks = leaks.groupBy("doc", "item", "windows", "matched").agg(F.min(F.struct(-F.col("n"), "shift", "slots", "changed")).alias("at"))
    leaks = leaks.select("doc", "item", "windows", "matched", "at.slots", "at.changed")
    return leaks.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "windows", "matched", (F.col("matched") / F.col("windows")).alias("coverage"),
        F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("changed", F.lit(0)).alias("changed"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked benchmark items of all documents."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    # DuckDB lists start at 1; i counts so
    marks = "'.', '!', '?', chr(10)"

    def name(i: str) -> str:
        begins = f"({i} = 1 or t[{i} - 1] in ({marks}))"
        return f"(regexp_matches(t[{i}], '{NAME}') and not ({begins} and lower(t[{i}]) in ({_quoted(FIRST_WORDS)})))"

    token = f"""case
        when regexp_matches(x, '^[0-9]') then struct_pack(c := '<n>', v := x)
        when x in ({marks}) then struct_pack(c := cast(null as varchar), v := cast(null as varchar))
        when i > 1 and regexp_matches(t[i - 1], '^[0-9]') and lower(x) in ({_quoted(UNITS)}) then struct_pack(c := '<u>', v := lower(x))
        when {name("i")} then case when i > 1 and {name("i - 1")} then struct_pack(c := cast(null as varchar), v := cast(null as varchar)) else struct_pack(c := '<a>', v := lower(x)) end
        else struct_pack(c := lower(x), v := cast(null as varchar)) end"""
    pattern = TOKEN.replace(r"\n", "\n")
    side = lambda i, table: f"""select id, list_filter(list_transform(t, lambda x, i: {token}), lambda y: y.c is not null) as y
        from (select {i} as id, regexp_extract_all(text, '{pattern}') as t from {table} where {i} is not null and text is not null)"""  # noqa: E731
    literals = "len(list_filter(y, lambda z: z.v is null))"
    cut = lambda table, which: f"""select distinct id, pos, h, s, n, false as whole from (select id, p as pos, y[p : p + n - 1] as w, n from (
        select id, y, n, unnest(range(1, len(y) - n + 2)) as p from {table}, (select unnest(range(1, {WINDOW + 1})) as n) where len(y) >= n and ({which}))),
        lateral (select array_to_string([z.c for z in w], ' ') || n as h, [z.v for z in w] as s) where len(list_filter(s, lambda z: z is null)) > 0"""  # noqa: E731
    whole = lambda table, which: f"""select distinct id, 1 as pos, array_to_string([z.c for z in y], ' ') || 'whole' as h, [z.v for z in y] as s, len(y) as n, true as whole
        from {table} where len(y) > 0 and {which}"""  # noqa: E731
    return f"""
with docs as ({side("doc_id", "documents")}), items as ({side("item_id", "benchmark")}),
bench as ({cut("items", f"{literals} >= {LITERALS} and n = least({WINDOW}, len(y))")} union all {whole("items", f"{literals} < {LITERALS}")}),
hits as ({cut("docs", "n in (select n from bench where not whole)")} union all {whole("docs", "true")}),
pairs as (select d.id as doc, b.id as item, d.pos, b.pos as ipos, d.pos - b.pos as shift, b.s as value, d.s from hits d join bench b using (h)),
totals as (select id as item, count(distinct pos) as windows, bool_or(whole) as whole from bench group by 1),
covered as (select doc, item, count(distinct ipos) as matched from pairs group by 1, 2),
binned as (select p.*, floor(shift / greatest(1, windows // 4)) as bin from pairs p join totals using (item)),
around as (select doc, item, bin, count(distinct ipos) as near from (select doc, item, ipos, unnest([bin - 1, bin, bin + 1]) as bin from binned) group by 1, 2, 3),
shifts as (select doc, item, shift, bin, count(distinct ipos) as n from binned group by 1, 2, 3, 4),
slots as (select distinct doc, item, shift, value[k] as a, s[k] as b from (select *, unnest(range(1, len(s) + 1)) as k from pairs) where value[k] is not null),
found as (select doc, item, shift, count(distinct a) as l, count(distinct b) as r, count(*) as slots, count(*) filter (a <> b) as changed from slots group by 1, 2, 3),
good as (select doc, item, n, shift, slots, changed, row_number() over (partition by doc, item order by n desc, shift) as r
    from shifts left join found using (doc, item, shift) join around using (doc, item, bin) join totals using (item)
    where (slots is null or (slots = l and slots = found.r)) and near >= {COVERAGE} * windows and (not whole or coalesce(changed, 0) = 0))
select c.doc as doc_id, c.item as item_id, windows, matched, matched / windows as coverage, coalesce(slots, 0) as slots, coalesce(changed, 0) as changed
from covered c join totals using (item) join good g on c.doc = g.doc and c.item = g.item and g.r = 1
where matched >= {COVERAGE} * windows"""


ORACLE = _oracle()
