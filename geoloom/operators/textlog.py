"""Jobs over logs of questions: triage by intent, routing to operators, parameter extraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode word characters and boundaries; only "\n" ends a line.
FLAGS = "(?Ud)"

# What makes a question a question about tables (any one pattern, any case).
META_PATTERNS = (
    r"\b(what|which|list|show|describe|tell me about|find|search|enumerate)\b.*(table|schema|column|database|catalog|namespace|dataset|layer)",
    r"\b(are there|is there|do we have|any)\b.*\b(table|dataset|layer|column|data)s?\b",
    r"\b(what|which)\s+(data|do we have)\b",
    r"\b(list|show)\s+(all\s+)?data\s*$",
    r"\b(got\s+any|have\s+any)\b.*\b(data|table|dataset)\b",
    r"\b(search|look)\s+for\b.*\b(data|table|dataset)\b",
    r"\b(sample|preview)\b.*\b(data|rows?|records?|table|dataset|layer|building|place|land)",
    r"\b(show|display|give)\b.*\b(first|top)\s+\d+\s+(rows?|records?)\b.*\b(of|from)\b",
    r"\b(sample|preview)\b.*\b\d+\b",
    r"\b(skip|exclude|without|no)\b.*\b(geom|geometry)\b",
    r"\b(show|give)\b.*\b(sample|preview)\b",
    r"\b(how many)\b.*\b(record|row|feature|entri|table|dataset|layer)s?\b",
    r"\brow\s+count\b",
    r"\b(summarize|summary|statistics|stats)\b",
    r"\b(bounding\s*box|bbox)\b.*\b(of|for)\b",
    r"\b(geographic\s+area|spatial\s+extent)\b",
    r"\b(extent|coverage)\b.*\b(of|for)\b",
    r"\b(what|which)\b.*(area|extent|coverage|region).*(cover|span|encompass)",
    r"\b(what|which|what's the)\b.*(type|kind)s?\s+of\s+(geometr|geom)",
    r"\b(geometry\s+types?)\b.*\b(for|of|in)\b",
    r"\b\w+\s+(geometry\s+types?|bounding\s+box|extent)\s*$",
    r"\b(snapshot|snapshots|version|history)\b.*\b(exist|available|for|of|list|show|what)\b",
    r"\b(what|which|list|show|any)\b.*\b(snapshot|snapshots|version|history)\b",
    r"\b(as\s+it\s+was|as\s+of|look(?:ed)?\s+like|at\s+snapshot)\b",
    r"\b(time\s+travel|historical|previous\s+version)\b",
    r"\b(what\s+did|what\s+was)\b.*\b(look|on|at|from)\b",
    r"\b(what\s+changed|diff|changes?\s+since)\b",
    r"\b(data\s+on)\b.*\b\d{4}\b",
    r"\b(at\s+(?:the\s+)?(?:earliest|latest|first|last))\b.*\b(snapshot|version)\b",
    r"\b(export|download)\b.*\b(as|to)?\s*(geojson|geo\s*json|csv|shapefile)\b",
    r"\b(export|download)\b.*\b(all|the|just)\b",
    r"\b(geojson)\b.*\b(export|of)\b",
    r"\b\w+\s+(?:as|to)\s+geojson\b",
)

# Words that make a question spatial.
SPATIAL_WORDS = (
    "near", "within", "buffer", "intersect", "distance",
    "polygon", "boundary", "adjacent", "surrounding", "closest",
    "overlap", "contains", "contain", "crosses", "touches",
    "inside", "outside", "lat", "lon", "longitude", "latitude", "map",
    "coordinate", "coords", "radius", "bbox", "envelope", "geometry",
    "spatial", "geom", "proximity",
    "meters", "meter", "kilometers", "kilometer", "km",
    "miles", "mile", "feet", "yard",
    "nearest", "farthest",
    "zone", "zones",
    "setback", "neighboring", "corridor",
    "centroid", "footprint",
    "north", "south", "east", "west",
    "layer", "scratch",
)

# Phrases that make a question spatial.
SPATIAL_PATTERNS = (
    r"\bhow\s+far\b",
    r"\b(join|match)\b.*\b(with|to)\b",
    r"\b(in|per|within|inside)\s+each\b.*\b(zone|tract|district|region|area|polygon|boundary|block|neighborhood)\b",
    r"\b(per)\s+(zone|tract|district|region|area|polygon|boundary|block|neighborhood)\b",
    r"\b(save|create|materialize)\b.*\b(layer|scratch|webmap|for the map)\b",
)

# Small talk, and the words that turn a short message into a question about data.
GREETING_PATTERN = r"^(hi|hello|hey|howdy|greetings|good\s+(morning|afternoon|evening))\b"
HELP_PATTERN = r"^(help|what can you do|how do(es)? (this|it) work)\s*\??$"
DATA_TERMS = (
    "table", "column", "count", "average", "sum", "select", "row",
    "data", "list", "preview", "sample", "describe", "stats",
    "bbox", "extent", "geojson", "export", "snapshot", "version",
)
SHORT_MESSAGE_WORDS = 4

# Months of written dates.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
WRITTEN_DATE = r"\b(" + "|".join(MONTHS) + r")\s+(\d{1,2}),?\s+(\d{4})\b"
SNAPSHOT_ID = r"\bsnapshot\s+(\d+)\b"
SAMPLE_SIZE = r"(?:first|top|sample\s+(?:of\s+)?)?(\d+)\s*(?:rows?|records?|features?|entries)"


def any_case(*patterns: str) -> str:
    return "(?i)(" + "|".join(patterns) + ")"


META = any_case(*META_PATTERNS)
SPATIAL = any_case(r"\b(?:" + "|".join(SPATIAL_WORDS) + r")\b", *SPATIAL_PATTERNS)
DATA_TERM = "(" + "|".join(DATA_TERMS) + ")"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def intent(text: Column) -> Column:
    """meta, spatial, conversational or analytics, by the first rule that holds."""
    stripped = F.regexp_replace(text, FLAGS + r"^\s+|\s+$", "")
    words = F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(stripped, FLAGS + r"\s+")))
    short = (words < SHORT_MESSAGE_WORDS) & ~matches(F.lower(text), DATA_TERM)
    return (
        F.when(matches(text, META), "meta")
        .when(matches(text, SPATIAL), "spatial")
        .when(matches(stripped, "(?i)" + GREETING_PATTERN), "conversational")
        .when(matches(stripped, "(?i)" + HELP_PATTERN), "conversational")
        .when(short, "conversational")
        .otherwise("analytics")
    )


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, group), F.lit(""))


def first_date(text: Column) -> Column:
    """Midnight of the first ISO date, else of the first written date, as text."""
    iso = _group(text, ISO_DATE, 1)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(_group(text, "(?i)" + WRITTEN_DATE, 1)))
    written = F.concat(
        _group(text, "(?i)" + WRITTEN_DATE, 3),
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad(_group(text, "(?i)" + WRITTEN_DATE, 2), 2, "0"),
    )
    return F.concat(F.coalesce(iso, written), F.lit(" 00:00:00"))


def snapshot_id(text: Column) -> Column:
    return _group(text, "(?i)" + SNAPSHOT_ID, 1).try_cast("long")


def sample_size(text: Column) -> Column:
    """Rows asked for, held to 1..100."""
    n = _group(text, "(?i)" + SAMPLE_SIZE, 1)
    # Longer digit runs overflow any integer and are certainly above the bound.
    n = F.when(F.length(n) > 9, F.lit(100)).otherwise(n.try_cast("int"))
    return F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(n, F.lit(100))))


def triage(df: DataFrame, text_col: str) -> DataFrame:
    """Add intent, first date, snapshot id and sample size to every message."""
    text = F.col(text_col)
    return df.withColumns(
        {
            "intent": intent(text),
            "asked_date": first_date(text),
            "snapshot_id": snapshot_id(text),
            "sample_n": sample_size(text),
        }
    )


@dataclass(frozen=True)
class Rule:
    """Messages that match ``pattern`` go to ``operator`` if what it ``needs`` can be read from the
    message: nothing, a ``table``, a ``column`` or a search ``topic``. A message that matches but
    lacks it goes on to the next rule when ``skips``, and nowhere otherwise.
    """

    operator: str
    pattern: str
    needs: str = ""
    skips: bool = False


# The routing rules, in order.
RULES = (
    Rule("list_namespaces", r"\b(what|which|list|show)\b.*\b(namespace|schema|catalog)s?\b"),
    Rule(
        "search_geometry_tables",
        r"\b(which|what|find|list|show)\b.*\b(table|dataset|layer)s?\b.*\b(geometry|geom|spatial|geographic)\b",
    ),
    Rule(
        "get_bbox",
        any_case(
            r"\b(bounding\s+box|bbox)\b",
            r"\b(geographic|spatial)\s+(area|extent|coverage|bounds)\b",
            r"\b(what|which)\b.*\b(area|extent|coverage|region)\b.*\b(cover|span|encompass)\b",
            r"\b(what|which|where)\b.*\b(area|extent|region)\b.*\b(does|do)\b",
            r"\b(area|extent|coverage|bounds)\b.*\b(of|for)\b.*\b(the|all)\b",
        ),
        "table",
    ),
    Rule("geometry_types", r"\b(what|which)\b.*\b(type|kind)s?\b.*\bgeometr", "table"),
    Rule(
        "table_stats",
        any_case(
            r"\b(how many|count|number of)\b.*\b(record|row|feature|point|line|polygon|entri)s?\b",
            r"\b(summarize|summary|statistics|stats)\b",
            r"\brow\s+count\b",
        ),
        "table",
    ),
    Rule(
        "sample_data",
        any_case(
            r"\b(show|give|display)\b.*\b(sample|preview)\b",
            r"\b(sample|preview)\b.*\b(data|rows?|records?|table|dataset|layer)\b",
            r"\bfirst\s+\d+\s+(rows?|records?|features?)\b",
        ),
        "table",
    ),
    Rule(
        "describe_table",
        any_case(
            r"\b(describe|explain)\b.*\b(schema|table|structure)\b",
            r"\b(what|which|list|show)\b.*\b(column|field|attribute)s?\b",
            r"\b(column|field|attribute)s?\b.*\b(of|for|in)\b",
        ),
        "table",
        skips=True,
    ),
    Rule(
        "search_tables_by_column",
        r"\b(table|dataset|layer)s?\b.*\b(with|having|contain(?:s|ing)?|has|have)\b.*\b(column|field|attribute)\b",
        "column",
        skips=True,
    ),
    Rule(
        "search_tables_by_column",
        r"\b(which|what|are there|do)\b.*\b(table|dataset|layer)s?\b.*\b(have|has|with|contain(?:s|ing)?)\b\s+(\w+)",
        "word",
        skips=True,
    ),
    Rule(
        "search_tables",
        r"\b(find|search|look\s+for|locate)\b.*\b(table|dataset|layer)s?\b.*\b(related|about|for|named|called|matching|like)\b",
        "topic",
        skips=True,
    ),
    Rule(
        "time_travel_query",
        any_case(
            r"\b(as\s+it\s+was|as\s+of|look(?:ed)?\s+like|at\s+snapshot|at\s+the\s+earliest)\b",
            r"\b(time\s+travel|historical|previous\s+version)\b",
            r"\b(data|table)\b.*\b(at|on|from)\b.*\b(\d{4}[-/]\d{2}|\bsnapshot\s+\d+)\b",
            r"\b(what\s+did)\b.*\b(look\s+like|as\s+of)\b.*\b(on|at|in)\b",
        ),
        "table",
    ),
    Rule(
        "table_snapshots",
        any_case(
            r"\b(what|which|list|show)\b.*\b(snapshots?|versions?|history)\b",
            r"\b(snapshots?|versions?)\b.*\b(exist|available|for|of)\b",
        ),
        "table",
    ),
    Rule("export_geojson", r"\b(export|download)\b.*\b(geojson|geo\s*json)\b", "table"),
    Rule(
        "list_tables",
        any_case(
            r"\b(what|which|list|show|display)\b.*\b(dataset|table|layer|data)s?\b",
            r"\bwhat('s| is)\b.*(available|in the (database|catalog|lakehouse))",
        ),
    ),
)

# Words that are never table, column or topic names.
STOP_WORDS = (
    "the", "a", "an", "all", "any", "some", "every", "each",
    "table", "tables", "dataset", "datasets", "layer", "layers",
    "schema", "column", "columns", "field", "fields", "attribute",
    "describe", "show", "list", "what", "which", "find", "search",
    "does", "do", "is", "are", "have", "has", "with", "in", "of", "for",
    "me", "my", "this", "that", "data", "available", "exist",
    "geometry", "geom", "spatial",
)

# Where a message names a table, column or topic.
QUOTED_NAME = r"['\"`](\w+)['\"`]"
THE_TABLE = r"(?i)\bthe\s+(\w+)\s+table\b"
OF_TABLE = r"(?i)\b(?:of|for|in)\s+(?:the\s+)?(\w+)\b(?:\s+table)?\s*$"
WITH_COLUMN = (
    r"(?i)\b(?:with|having|contain(?:ing)?|has|have)\s+(?:a\s+)?['\"]?(\w+)['\"]?\s+(?:column|field|attribute)\b"
)
COLUMN_NAMED = r"(?i)\b(?:column|field|attribute)\s+(?:named|called)\s+['\"]?(\w+)['\"]?"
SEARCH_TOPIC = (
    r"(?i)\b(?:table|dataset|layer)s?\b.*\b(?:related\s+to|about|for|named|called|matching|like)\s+['\"]?(\w+)['\"]?"
)

# Features that stand for a table nobody named, by table.
FEATURE_WORDS = {
    "buildings": (
        "school", "hospital", "church", "house", "apartment",
        "office", "warehouse", "garage", "shed", "commercial",
        "industrial", "residential", "kindergarten",
    ),
    "places": (
        "restaurant", "cafe", "hotel", "shop", "store", "bar",
        "pharmacy", "bank", "supermarket", "museum", "park",
    ),
}


def _name(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured name unless it is a stop word."""
    found = _group(text, pattern, group)
    return F.when(~F.lower(found).isin(*STOP_WORDS), found)


def _known(text: Column, word: str) -> Column:
    import re

    return matches(text, r"(?i)\b" + re.escape(word) + r"\b")


def table_ref(text: Column, tables: list[str]) -> Column:
    """The table a message names: a known ``namespace.table``, a known table name, a quoted name,
    "the X table", or "of/for/in X" at the end.
    """
    named = [F.when(_known(text, t), F.lit(t)) for t in tables]
    named += [F.when(_known(text, t.rpartition(".")[2]), F.lit(t)) for t in tables]
    ending = F.regexp_replace(F.trim(text), r"\?+$", "")
    guesses = [_group(text, QUOTED_NAME, 1), _name(text, THE_TABLE), _name(ending, OF_TABLE)]
    return F.coalesce(*named, *[F.concat(F.lit("default."), g) for g in guesses])


def _inferred_table(text: Column, tables: list[str]) -> Column:
    guesses = [F.lit(None).cast("string")]
    for name, words in FEATURE_WORDS.items():
        home = next((t for t in tables if t.rpartition(".")[2].lower() == name), None)
        if home:
            guesses.append(F.when(matches(text, r"(?i)\b(?:" + "|".join(words) + r")s?\b"), F.lit(home)))
    return F.coalesce(*guesses)


def _namespace_ref(text: Column, tables: list[str]) -> Column:
    spaces = dict.fromkeys(t.rpartition(".")[0] for t in tables)
    known = [F.when(_known(text, s), F.lit(s)) for s in spaces if s and not s.startswith("_")]
    return F.coalesce(F.lit(None).cast("string"), *known)


def route(df: DataFrame, text_col: str, tables: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the operator each message asks for (null if none) and what it applies to."""
    text = F.col(text_col)
    reference = table_ref(text, tables)
    readings = {
        "": F.lit(""),
        "table": reference,
        "column": F.coalesce(_name(text, WITH_COLUMN), _group(text, COLUMN_NAMED, 1)),
        "topic": _name(text, SEARCH_TOPIC),
    }
    nothing = F.struct(F.lit(None).cast("string").alias("operator"), F.lit(None).cast("string").alias("target"))
    chosen = nothing
    for rule in reversed(rules):
        pattern = "(?i)" + rule.pattern
        if rule.needs == "word":
            target = F.lower(_name(text, pattern, 4))
        elif rule.operator == "geometry_types":
            target = F.coalesce(reference, _namespace_ref(text, tables))
        elif rule.operator == "export_geojson":
            target = F.coalesce(reference, _inferred_table(text, tables))
        else:
            target = readings[rule.needs]
        hit = F.struct(F.lit(rule.operator).alias("operator"), F.nullif(target, F.lit("")).alias("target"))
        applies = matches(text, pattern)
        if rule.skips:
            chosen = F.when(applies & target.isNotNull(), hit).otherwise(chosen)
        else:
            chosen = F.when(applies, F.when(target.isNotNull(), hit).otherwise(nothing)).otherwise(chosen)
    # As of no version and no time, only the list of versions can be shown.
    dated = snapshot_id(text).isNotNull() | first_date(text).isNotNull()
    undated = (F.col("_route.operator") == "time_travel_query") & ~dated
    operator = F.when(undated, "table_snapshots").otherwise(F.col("_route.operator"))
    return (
        df.withColumn("_route", chosen)
        .withColumns({"operator": operator, "target": F.col("_route.target")})
        .drop("_route")
    )
