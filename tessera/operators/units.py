"""Problem 5: quantities recorded in different units, brought to the unit of their metric.

Units are the nodes of a graph; an edge is an affine function y = scale * x + offset between
two units. The shortest composition of edges is worked out for every pair of units that are
linked, each further path must agree with it (cycle consistency), and the table of
compositions is joined to the mentions on source unit and target unit. Where a mention has
no unit or no value, they are read from its words.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

# Conversions, one unit of the first being scale units of the second, plus offset.
EDGES: tuple[tuple[str, str, float, float], ...] = (
    ("kUSD", "USD", 1e3, 0), ("MUSD", "kUSD", 1e3, 0), ("BUSD", "MUSD", 1e3, 0),
    ("ratio", "percent", 100, 0), ("percent", "bp", 100, 0), ("ratio", "bp", 1e4, 0),
    ("week", "day", 7, 0), ("day", "hour", 24, 0), ("week", "hour", 168, 0), ("hour", "minute", 60, 0),
    ("t", "kg", 1000, 0), ("kt", "t", 1000, 0), ("Mt", "kt", 1000, 0), ("kg", "g", 1000, 0), ("lb", "kg", 0.45359237, 0), ("oz", "lb", 1 / 16, 0), ("short_ton", "lb", 2000, 0),
    ("ha", "m2", 1e4, 0), ("km2", "ha", 100, 0), ("ft2", "m2", 0.09290304, 0), ("acre", "ft2", 43560, 0), ("acre", "m2", 4046.8564224, 0),
    ("MWh", "kWh", 1000, 0), ("GWh", "MWh", 1000, 0), ("TWh", "GWh", 1000, 0), ("MWh", "GJ", 3.6, 0), ("GJ", "MJ", 1000, 0), ("TJ", "GJ", 1000, 0),
    ("m3", "l", 1000, 0), ("gal", "l", 3.785411784, 0), ("bbl", "gal", 42, 0), ("bbl", "l", 158.987294928, 0), ("l", "ml", 1000, 0),
    ("degF", "degC", 5 / 9, -160 / 9), ("K", "degC", 1, -273.15), ("degF", "K", 5 / 9, 459.67 * 5 / 9),
    ("km", "m", 1000, 0), ("mi", "km", 1.609344, 0), ("ft", "m", 0.3048, 0), ("mi", "ft", 5280, 0), ("m", "cm", 100, 0),
    ("dozen", "unit", 12, 0), ("kunit", "unit", 1000, 0), ("Munit", "kunit", 1000, 0), ("Bunit", "Munit", 1000, 0),
)

# Spellings of plain units, lower-cased unless case tells units apart.
SPELLINGS: dict[str, str] = {
    "USD": "$ usd us$ dollar dollars us-dollar us-dollars dollar-us dólar dólares",
    "percent": "% pct percent per-cent percentage prozent pour-cent por-ciento percent-of-the-base percentage-of-the-base %-of-the-base percentage-points pp percentage-point",
    "bp": "bp bps basis-point basis-points basispunkt basispunkte point-de-base points-de-base punto-básico puntos-básicos",
    "ratio": "ratio fraction fraction-of-one ratio-of x times multiple multiples fach veces fois",
    "day": "d day days tag tage tagen jour jours día días", "week": "wk wks week weeks woche wochen semaine semaines semana semanas", "hour": "h hr hrs hour hours stunde stunden heure heures hora horas", "minute": "min mins minute minutes minuten minutos",
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes kilogramm kilogramos", "g": "g gram grams gramme grammes gramm gramos", "lb": "lb lbs pound pounds pfund livres libras", "oz": "oz ounce ounces", "short_ton": "short-ton short-tons us-ton us-tons",
    "t": "t mt tonne tonnes ton tons metric-ton metric-tons metric-tonnes tonnen tonelada toneladas",
    "m2": "sqm m2 m² sq-m square-metre square-metres square-meter square-meters quadratmeter qm mètre-carré mètres-carrés metro-cuadrado metros-cuadrados", "ha": "ha hectare hectares hektar hectárea hectáreas", "km2": "km2 km² sq-km square-kilometres square-kilometers quadratkilometer", "ft2": "sq-ft sqft ft2 ft² square-foot square-feet", "acre": "ac acre acres",
    "kWh": "kwh kilowatt-hour kilowatt-hours", "MWh": "mwh megawatt-hour megawatt-hours megawattstunden mégawattheures", "GWh": "gwh gigawatt-hour gigawatt-hours gigawattstunden gigawattheures", "TWh": "twh terawatt-hour terawatt-hours", "GJ": "gj gigajoule gigajoules", "MJ": "mj megajoule megajoules", "TJ": "tj terajoule terajoules",
    "l": "l liter liters litre litres litern litro litros", "ml": "ml millilitre millilitres", "m3": "m3 m³ cbm cubic-metre cubic-metres cubic-meter cubic-meters kubikmeter mètres-cubes metros-cúbicos", "gal": "gal gallon gallons us-gallon us-gallons", "bbl": "bbl bbls barrel barrels fass baril barils barriles",
    "degC": "°c degc celsius degree-celsius degrees-celsius grad-celsius degrés-celsius grados-celsius c", "degF": "°f degf fahrenheit degree-fahrenheit degrees-fahrenheit f", "K": "k kelvin kelvins",
    "m": "m metre metres meter meters mètre mètres metro metros", "km": "km kms kilometre kilometres kilometer kilometers kilomètre kilomètres kilómetro kilómetros", "mi": "mi mile miles meile meilen", "ft": "ft foot feet", "cm": "cm centimetre centimetres",
    "unit": "unit units pcs piece pieces stück unité unités d'unités unidad unidades de-unidades", "dozen": "dozen dozens dutzend docena docenas douzaine douzaines",
}
# Words for powers of ten, and the units that take them.
SCALES: dict[int, str] = {
    3: "k thousand thousands 000 000s '000 tsd tausend millier milliers mil miles",
    6: "m mm mn mio million millions millón millones millionen",
    9: "b bn mrd billion billions milliard milliards milliarden mil-millones",
}
SCALED: dict[tuple[str, int], str] = {
    ("USD", 3): "kUSD", ("USD", 6): "MUSD", ("USD", 9): "BUSD", ("unit", 3): "kunit", ("unit", 6): "Munit", ("unit", 9): "Bunit", ("t", 3): "kt", ("t", 6): "Mt", ("m", 3): "km", ("g", 3): "kg", ("l", 3): "m3",
}
#: Spellings that are a scaled unit in one word.
WHOLE: dict[str, str] = {"kt": "kt", "kilotonne": "kt", "kilotonnes": "kt", "$k": "kUSD", "$m": "MUSD", "$mm": "MUSD", "$mn": "MUSD", "$b": "BUSD", "$bn": "BUSD"}
FOREIGN = frozenset(
    """
    für lag von bei der die das und mit im betrug wurde millionen milliarden mio mrd tsd prozent basispunkte tage wochen stunden tonnen hektar quadratmeter stück
    nannte den wert
    atteint indique au titre de les des le la et du était milliers milliards jours heures semaines mètres carrés unités
    el los las por para en del fue registró comunicó según con millones mil días horas semanas toneladas hectáreas metros cuadrados ciento puntos dólares
    """.split()
) - {"de", "la", "en", "die", "das", "mil", "los", "den"}

_JOINERS = frozenset("of the in as a an de d' stated amounts figures expressed us".split())
_NUMBER = re.compile(r"(?P<open>\()?(?P<sign>[-−–])?\s?(?:(?:US)?\$|USD\s?|€)?\s?(?P<sign2>[-−–])?(?P<n>\d(?:[\d.,'’\xa0  ]|[ ](?=\d{3}(?!\d)))*\d|\d)")
_PIECES = re.compile(r"[$%]|°[CFcf]|'?0{3}s?(?!\d)|m[²³23]|ft[²2]|km[²2]|[^\W\d_]+(?:['’][^\W\d_]+)?\.?", re.U)
_PHRASES: dict[str, tuple[str, int]] = {}


def _phrases() -> dict[str, tuple[str, int]]:
    """Spelling, words joined by '-', to (unit, 0) or to ('', power of ten)."""
    if not _PHRASES:
        for p, said in SCALES.items():
            for s in said.split():
                _PHRASES[s] = ("", p)
        for u, said in SPELLINGS.items():
            for s in said.split():
                _PHRASES.setdefault("=" + s, (u, 0))
    return _PHRASES


def read_unit(said: str | None) -> str | None:
    """The unit that a spelling names, such as '$ 000', 'billion USD', 'Mrd. Dollar', 'thousands of tonnes'; None if none."""
    if not said or not said.strip():
        return None
    whole = said.strip()
    if whole in ("K", "k"):
        return "K"
    if whole.lower() in WHOLE:
        return WHOLE[whole.lower()]
    table, words = _phrases(), [w.lower().rstrip(".") for w in _PIECES.findall(whole)]
    if words and words[0] == "usd" and len(words) == 2 and words[1] in ("m", "k", "b"):
        words = ["$", words[1]]
    power, unit, i, left = 0, None, 0, []
    while i < len(words):
        for n in (4, 3, 2, 1):
            phrase = "-".join(words[i : i + n])
            if i + n > len(words):
                continue
            if "=" + phrase in table and (unit is None or unit == table["=" + phrase][0]) and not (n == 1 and phrase in table and (unit is not None or len(words) > 1 and phrase in ("k", "m", "miles"))):
                unit = table["=" + phrase][0]
                break
            if phrase in table:
                power += table[phrase][1]
                break
        else:
            n = 1
            left.append(words[i])
        i += n
    if unit is None or any(w not in _JOINERS for w in left):
        return None
    return unit if not power else SCALED.get((unit, power))


def _foreign(text: str) -> bool:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return any(w in FOREIGN for w in words)


def read_number(text: str | None, sentence: str | None = None) -> tuple[float, str] | None:
    """(number, words around it) of the first number of ``text``, in English, German, French or Spanish style; None if there is none."""
    m = _NUMBER.search(text or "")
    if not m:
        return None
    raw, foreign = re.sub(r"['’ \xa0  ]", "", m["n"]), _foreign(f"{text} {sentence or ''}")
    dots, commas = raw.count("."), raw.count(",")
    groups = re.fullmatch(r"[1-9]\d{0,2}([.,]\d{3})+", raw)
    if dots and commas:
        decimal = max(raw.rfind("."), raw.rfind(","))
        decimal = raw[decimal] if raw.count(raw[decimal]) == 1 else None
    elif dots > 1 or commas > 1:
        decimal = None
    elif commas:
        decimal = "," if foreign or not groups else None
    elif dots:
        decimal = None if foreign and groups else "."
    else:
        decimal = None
    plain = "".join("." if c == decimal else c for c in raw if c.isdigit() or c == decimal)
    around = (text or "")[: m.start("n")] + " " + (text or "")[m.end("n") :]
    negative = bool(m["sign"] or m["sign2"] or (m["open"] and (text or "")[m.end() : m.end() + 1] == ")"))
    return (-float(plain) if negative else float(plain)), re.sub(r"[()\-−–]", " ", around).strip()


_TOLD = re.compile(r"\b(?:in|as an?|as|stated in)\s+((?:[^\W\d_]+\.?\s+|\$\s*){0,4}?(?:[^\W\d_]+|\$|%|m[²³23]|ft2|°[CF]))\s*(?=[):,.;]|$| put\b| shows?\b| at\b| for\b)", re.I)


def told_unit(text: str | None, sentence: str | None) -> str | None:
    """The unit told by the words around the number in ``text``, else by a phrase such as '(in thousands of dollars)' of the sentence."""
    read = read_number(text)
    if (own := read_unit(read[1] if read else text)) is not None:
        return own
    if read and (pair := re.fullmatch(r"(\S+)\s+(.+)", read[1])) and pair[1].lower() in ("usd", "$") and (own := read_unit(f"{pair[2]} $")):
        return own
    for m in _TOLD.finditer(sentence or ""):
        words = m[1].split()
        for i in range(len(words)):
            if (u := read_unit(" ".join(words[i:]))) is not None:
                return u
    return None


def compositions(edges: Iterable[tuple[str, str, float, float]] = EDGES) -> dict[tuple[str, str], tuple[float, float, int]]:
    """(source, target) to (scale, offset, number of edges) by the shortest path, for every two linked units and each with itself.

    Raises ValueError where a cycle is inconsistent: an edge must do what the path between
    its ends does, to within 1e-9 of the scale and the offset. The graph is a dimension of a few
    dozen units, worked out on the driver.
    """
    out: dict[str, list[tuple[str, float, float]]] = {}
    known = list(edges)
    for a, b, k, c in known:
        if k == 0:
            raise ValueError(f"{a} to {b} has no inverse")
        out.setdefault(a, []).append((b, k, c))
        out.setdefault(b, []).append((a, 1 / k, -c / k))
    paths: dict[tuple[str, str], tuple[float, float, int]] = {}
    for start in out:
        paths[start, start] = (1.0, 0.0, 0)
        todo = deque([start])
        while todo:
            at = todo.popleft()
            k0, c0, n = paths[start, at]
            for b, k, c in out[at]:
                if (start, b) not in paths:
                    paths[start, b] = (k * k0, k * c0 + c, n + 1)
                    todo.append(b)
    for start in out:
        for a, b, k, c in known:
            if (start, a) in paths:
                (ka, ca, _), (kb, cb, _) = paths[start, a], paths[start, b]
                if abs(k * ka - kb) > 1e-9 * abs(kb) or abs(k * ca + c - cb) > 1e-9 * max(1.0, abs(cb)):
                    raise ValueError(f"the cycle over {a} and {b} is inconsistent")
    return paths


def conversion_table(spark: SparkSession, edges: Iterable[tuple[str, str, float, float]] = EDGES) -> DataFrame:
    """(source, target, scale, offset, hops): all compositions, at most the square of the number of units."""
    rows = [(a, b, k, c, n) for (a, b), (k, c, n) in sorted(compositions(edges).items())]
    return spark.createDataFrame(rows, "source string, target string, scale double, offset double, hops int")


def amounts(mentions: DataFrame, metrics: DataFrame, edges: Iterable[tuple[str, str, float, float]] = EDGES) -> DataFrame:
    """(mention_id, metric_id, recorded, number, source, target, amount, amount_high): every mention once, in the unit of its metric.

    ``recorded`` is the value as given, ``number`` that or, where null, the number read from
    the text, ``source`` its unit: the given one, else the one told by text or sentence; a
    number read from a text that names its own unit is in that unit. ``amount`` is null
    where number, unit or metric is missing or unknown, or where the units measure different things.
    Repeated mention ids count once; empty tables give an empty result; other columns are ignored.
    """
    spark = mentions.sparkSession
    rows = mentions.select(F.col("mention_id").cast("long").alias("mention_id"), F.col("metric_id").cast("string").alias("metric_id"), F.col("value").cast("double").alias("value"), F.col("high").cast("double").alias("high"), F.col("unit").cast("string").alias("unit"), F.col("text").cast("string").alias("text"), F.col("sentence").cast("string").alias("sentence")).where("mention_id is not null").dropDuplicates(["mention_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spelled: dict[str, str | None] = {}
        for pdf in batches:
            numbers, units = [], []
            for value, unit, text, sentence in zip(pdf["value"], pdf["unit"], pdf["text"], pdf["sentence"]):
                missing = value is None or value != value
                given = None
                if unit is not None and unit.strip():
                    if unit not in spelled:
                        spelled[unit] = read_unit(unit)
                    given = spelled[unit]
                if missing:
                    read = read_number(text, sentence)
                    numbers.append(read[0] if read else None)
                    units.append((read_unit(read[1]) if read else None) or given or told_unit(text, sentence))
                else:
                    numbers.append(value)
                    units.append(given or told_unit(text, sentence))
            yield pdf[["mention_id", "metric_id", "value", "high"]].rename(columns={"value": "recorded"}).assign(number=pd.array(numbers, "Float64"), source=units)

    read = rows.mapInPandas(run, "mention_id long, metric_id string, recorded double, high double, number double, source string")
    targets = metrics.select(F.col("metric_id").cast("string").alias("metric_id"), F.col("unit").cast("string").alias("unit")).where("metric_id is not null").dropDuplicates(["metric_id"])

    def name(units: pd.Series) -> pd.Series:
        return units.map(read_unit)

    targets = targets.select("metric_id", F.pandas_udf(name, "string")("unit").alias("target"))
    table = conversion_table(spark, edges)
    to = read.join(targets, "metric_id", "left").join(F.broadcast(table), ["source", "target"], "left")
    return to.select("mention_id", "metric_id", "recorded", "number", "source", "target", (F.col("number") * F.col("scale") + F.col("offset")).alias("amount"), (F.col("high") * F.col("scale") + F.col("offset")).alias("amount_high"))


def same_amounts(mentions: DataFrame, metrics: DataFrame, *, within: float = 0.005) -> DataFrame:
    """(lo, hi): mentions of one accession, metric and period whose amounts agree within ``within`` of the larger, though their recorded values do not or one is null.

    Amounts meet by bands of their logarithm, each looked up with its neighbours, so a group
    of many different amounts is not compared all with all. Null accession, metric, period or
    amount: no pair. Zero agrees with zero. Otherwise as in amounts.
    """
    keys = ["accession", "metric_id", "period_key"]
    of = mentions.select(F.col("mention_id").cast("long").alias("mention_id"), *[F.col(k).cast("string").alias(k) for k in keys if k != "metric_id"]).dropDuplicates(["mention_id"])
    band = F.when(F.col("amount") == 0, F.lit(None).cast("long")).otherwise(F.floor(F.log(F.abs("amount")) / F.log(F.lit(1 / (1 - within)))))
    rows = amounts(mentions, metrics).join(of, "mention_id").where("amount is not null and accession is not null and metric_id is not null and period_key is not null")
    rows = cut(rows.select("mention_id", *keys, "recorded", "amount", F.signum("amount").cast("int").alias("sign"), F.coalesce(band, F.lit(-(1 << 40))).alias("band")))
    x = rows.select(*keys, "sign", "band", F.col("mention_id").alias("x"), F.col("recorded").alias("rx"), F.col("amount").alias("ax"))
    y = rows.select(*keys, "sign", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("mention_id").alias("y"), F.col("recorded").alias("ry"), F.col("amount").alias("ay"))
    differ = lambda a, b: F.abs(F.col(a) - F.col(b)) > within * F.greatest(F.abs(F.col(a)), F.abs(F.col(b))) * (1 + 1e-9)
    both = x.join(y, [*keys, "sign", "band"]).where("x < y")
    return both.where(~differ("ax", "ay") & (F.col("rx").isNull() | F.col("ry").isNull() | differ("rx", "ry"))).select(F.col("x").alias("lo"), F.col("y").alias("hi")).distinct()
