"""Names, tags and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of bus and rail stops in station names (regular expressions, either case).
BUS_MARKS = r"(?i)(,|aut\.\s*st\.|autobusové|autobus|bus\b|Busbahnhof|Busstop|ZOB|zast\.$| zast\.)"
RAIL_MARKS = r"(?i)(nádraží|hlavní|nádr\.|hl\.n\.|Hbf|Bahnhof|banegård|banegaard| St\.| st\.$|Station|railway|Hauptbahnhof|železniční stanice)"
#: City names by language.
CITY_VARIANTS = {
    "copenhagen": ["københavn", "koebenhavn"], "københavn": ["copenhagen"], "vienna": ["wien"], "wien": ["vienna"], "prague": ["praha"],
    "praha": ["prague"], "munich": ["münchen", "muenchen"], "münchen": ["munich"], "cologne": ["köln", "koeln"], "köln": ["cologne"],
    "nuremberg": ["nürnberg", "nuernberg"], "nürnberg": ["nuremberg"], "aarhus": ["århus"], "århus": ["aarhus"], "gothenburg": ["göteborg"],
    "göteborg": ["gothenburg"], "warsaw": ["warszawa"], "warszawa": ["warsaw"],
}
LODGING = ("hotel", "hostel", "guest_house", "motel", "camp_site", "wilderness_hut")
FOOD = ("restaurant", "cafe", "fast_food", "pub", "bar", "biergarten")


def station_key(name: Column) -> Column:
    """Lower-cased name without a trailing platform number, abbreviations spelled out."""
    bare = F.lower(F.trim(F.regexp_replace(name, r"(?i)\s+g?\d+\s*$", "")))
    return F.regexp_replace(F.regexp_replace(bare, r"\bhbf\b", "hauptbahnhof"), r"\bbhf\b", "bahnhof")


def station_mode(name: Column) -> Column:
    """bus, rail or unknown by the name alone; bus marks win."""
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(name.rlike(BUS_MARKS), "bus").when(name.rlike(RAIL_MARKS), "rail").otherwise("unknown")


def query_variants(query: str) -> list[str]:
    """A search text and its known forms in other languages, in order, each once."""
    q = query.strip().lower()
    return list(dict.fromkeys([q, *CITY_VARIANTS.get(q, [])])) if q else []


def gtfs_mode(route_type: Column) -> Column:
    """rail, bus or other by the GTFS route type."""
    return F.when((route_type == 2) | route_type.between(100, 117), "rail").when(route_type.isin(3, 11) | route_type.between(700, 799), "bus").otherwise("other")


def mislabelled_bus(country: Column, short_name: Column, agency: Column, marks: list[str]) -> Column:
    """A route of rail type that is a bus: by its agency's name, or by the prefix of its number in the Czech feed."""
    by_agency = F.lit(False)
    for m in marks:
        by_agency = by_agency | F.contains(F.lower(F.coalesce(agency, F.lit(""))), F.lit(m))
    return by_agency | ((country == "czech-republic") & F.coalesce(short_name, F.lit("")).rlike(r"^(Vlak|V\d|U\d|M\d|L\d)"))


def poi_category(tourism: Column, amenity: Column, shop: Column) -> Column:
    """struct(category, subtype) of a point of interest, null for others."""
    of = lambda c, s: F.struct(F.lit(c).alias("category"), s.alias("subtype"))
    return (
        F.when(tourism == "viewpoint", of("viewpoint", tourism)).when(tourism.isin(*LODGING), of("lodging", tourism)).when(amenity.isin(*FOOD), of("food", amenity))
        .when(amenity == "drinking_water", of("water", amenity)).when((amenity == "bicycle_repair_station") | (shop == "bicycle"), of("bike_service", F.coalesce(amenity, shop)))
    )


def landcover_class(landuse: Column, natural: Column) -> Column:
    return (
        F.when((landuse == "forest") | (natural == "wood"), "forest").when((natural == "water") | (landuse == "reservoir"), "water")
        .when(natural == "wetland", "wetland").when(landuse == "vineyard", "vineyard")
    )


def oneway_direction(tag: Column) -> Column:
    """-1 for reverse only, 1 for forward only, 0 for both."""
    t = F.lower(F.coalesce(tag, F.lit("")))
    return F.when(t.isin("-1", "reverse"), -1).when(t.isin("yes", "true", "1"), 1).otherwise(0)


def miles_guard(km: Column) -> Column:
    """A stage length between 15 and 50 is taken to be meant in miles."""
    return F.when(km.between(15, 50), km * 1.60934).otherwise(km)


def ref_parts(ref: Column) -> tuple[Column, Column]:
    """kind and id of a reference ``kind:id``; the id is null unless it is a whole number."""
    return F.split_part(ref, F.lit(":"), F.lit(1)), F.split_part(ref, F.lit(":"), F.lit(2)).try_cast("long")


def lon_lat(text: Column) -> tuple[Column, Column]:
    """Numbers of a text ``lon,lat``; null where malformed."""
    return F.split_part(text, F.lit(","), F.lit(1)).try_cast("double"), F.split_part(text, F.lit(","), F.lit(2)).try_cast("double")


def truncated(text: Column, n: int = 200) -> Column:
    """At most n characters, with a mark where something is missing."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


# Journey planners by country: label, address, names of the two places, date parameter and its form.
PLANNERS = {
    "germany": ("DB (bahn.de)", "https://www.bahn.de/buchung/fahrplan/suche#sts=true&", (("S", 0), ("Z", 1)), "date", False),
    "czech-republic": ("ČD (idos.cz)", "https://idos.cz/vlaky/spojeni/vysledky/?", (("f", 0), ("t", 1)), "date", False),
    "austria": ("ÖBB Scotty", "https://fahrplan.oebb.at/webapp/#!?", (("Sf", 0), ("Sz", 1), ("S", 0), ("Z", 1)), "date", True),
    "denmark": ("Rejseplanen", "https://www.rejseplanen.dk/webapp/?", (("origin", 0), ("destination", 1)), "date", False),
}


def planner_link(country: str, start: Column, end: Column, date: Column | None = None) -> Column:
    """struct(operator, url) of a country's journey planner."""
    label, address, places, date_name, dotted = PLANNERS[country]
    parts = [F.concat(F.lit(f"{k}="), F.url_encode((start, end)[i])) for k, i in places]
    if date is not None:
        shown = F.concat_ws(".", F.split_part(date, F.lit("-"), F.lit(3)), F.split_part(date, F.lit("-"), F.lit(2)), F.split_part(date, F.lit("-"), F.lit(1))) if dotted else date
        parts.append(F.when(date.isNotNull(), F.concat(F.lit(f"{date_name}="), F.url_encode(shown))))
    return F.struct(F.lit(label).alias("operator"), F.concat(F.lit(address), F.concat_ws("&", *parts)).alias("url"))


def booking_links(start: Column, end: Column, from_country: Column, to_country: Column, date: Column | None = None) -> Column:
    """Links for a journey: at home the country's planner first, abroad the German one first; maps at the end."""
    none = F.lit(None).cast("struct<operator:string,url:string>")
    own = none
    for country in PLANNERS:
        own = F.when(from_country == country, planner_link(country, start, end, date)).otherwise(own)
    db = planner_link("germany", start, end, date)
    home = from_country == to_country
    abroad_own = F.when(from_country != "germany", own).otherwise(none)
    maps = F.concat(F.lit("https://www.google.com/maps/dir/?api=1&origin="), F.url_encode(start), F.lit("&destination="), F.url_encode(end), F.lit("&travelmode=transit"))
    last = F.struct(F.lit("Google Maps (transit)").alias("operator"), maps.alias("url"))
    links = F.when(home, F.array(own, db, last)).otherwise(F.array(db, abroad_own, last))
    return F.filter(links, lambda x: x.isNotNull())


def shortened(values: Column, n: int = 20) -> Column:
    """At most n elements of a list."""
    return F.slice(values, 1, n)


def mentioned(text: Column, words: list[str]) -> Column:
    """The words that a text holds as whole words in any case, in their order there, each once."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(words) + r")\b"), F.lit(1))
    return F.array_distinct(found)


def in_scope(text: Column, triggers: list[str]) -> Column:
    """Some trigger stands anywhere in the text, in any case."""
    low = F.lower(text)
    out = F.lit(False)
    for t in triggers:
        out = out | F.contains(low, F.lit(t))
    return out


def days_moved(text: Column, offset: Column, most: Column) -> Column:
    """``Day n`` in prose, and n in the first cell of a table row, moved on by ``offset`` where n is at most ``most`` + 5.

    A match's replacement depends on its number, so each number up to the bound is replaced behind a mark that keeps it
    from being replaced again.
    """

    def moved(whole: Column) -> Column:
        number = lambda acc, n: F.regexp_replace(
            F.regexp_replace(acc, F.concat(F.lit(r"(?i)\bDay\s+0*"), n.cast("string"), F.lit(r"\b")), F.concat(F.lit("Day \u0001"), (n + offset).cast("string"))),
            F.concat(F.lit(r"(?m)^(\s*\|\s*)0*"), n.cast("string"), F.lit(r"(\s*\|)")),
            F.concat(F.lit("$1\u0001"), (n + offset).cast("string"), F.lit("$2")),
        )
        return F.aggregate(F.sequence(F.lit(1), most + 5), whole, number, lambda x: F.replace(x, F.lit("\u0001"), F.lit("")))

    return F.when(text.isNull() | (offset == 0), text).otherwise(moved(text))


#: What a tool's answer is counted by, and how that is called.
DIGESTS = {
    "search_anchors": ("results", "hits"), "stations_near": ("stations", "stations"), "stations_along_route": ("anchors", "rail-served anchors"),
    "split_into_stages": ("stages", "stages"), "pois_near_anchor": ("pois", "POIs"), "pois_along_route": ("pois", "POIs"),
}


def output_digest(tool: Column, output: Column) -> Column:
    """A line about a tool's answer in JSON: its error, its counts, or ok."""
    get = lambda path: F.get_json_object(output, path)
    shown = lambda path: F.coalesce(get(path), F.lit("None"))
    out = F.lit("ok")
    for name, (field, what) in DIGESTS.items():
        n = F.coalesce(F.json_array_length(get(f"$.{field}")), F.lit(0))
        out = F.when(tool == name, F.concat_ws(" ", n.cast("string"), F.lit(what))).otherwise(out)
    stops = F.coalesce(F.json_array_length(get("$.chain_stops")), F.lit(0)).cast("string")
    out = F.when(tool == "route", F.concat(shown("$.total_km"), F.lit(" km, "), stops, F.lit(" stops"))).otherwise(out)
    return F.when(get("$.error").isNotNull(), F.concat(F.lit("error: "), get("$.error"))).otherwise(out)
