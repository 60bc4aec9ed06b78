"""Rule-based classes: the four categories of books, and sensitive topics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of each category, in the order in which categories are tried. They match whole words only.
CATEGORIES = (
    ("dramatic", r"fiction|novel|novella|drama|plays?|mystery|detective|romance|love\s+stor|thriller|suspense|horror|gothic|supernatural|ghost\s+stor|fantasy|fairy\s+tales?|folk\s+tales?|fables?|science\s+fiction|sci-fi|satire|comedy|humou?r(?:ous)?|allegory|fable|parable|adventure(?:\s+stories?)?|sea\s+stories?|war\s+stories?|western\s+stories?|short\s+stories?|antholog|bildungsroman|picaresque|epistolary|dystopi|utopi|young\s+adult|historical\s+fiction|crime\s+fiction|domestic\s+fiction|social\s+fiction|children.s\s+(?:fiction|literature|stories?)|melodrama|tragedy|farce|manga|comic|graphic\s+novel"),
    ("analytical", r"natural\s+histor|art\s+histor|church\s+histor|literary\s+histor|literary\s+criticism|music\s+theor|political\s+econom|social\s+science|computer\s+science|political\s+science|natural\s+philosoph|architecture|science|mathematics|math|physics|chemistry|astronomy|biology|botany|zoology|ecology|anatomy|physiology|geology|mineralogy|paleontolog|medicine|surgery|pharmacolog|engineering|technology|philosophy|ethics|logic|metaphysics|economics|econom|politics|government|law|jurisprudence|sociology|anthropology|linguistics|grammar|philolog|rhetoric|theology|religion(?:\s+\w+)?|spirituality|psychology|psychiatry|archaeology|geography|cartography|textbook|treatise"),
    ("biographical", r"biograph|autobiograph|memoir|memoirs|diaries?|diary|correspondence|letters|reminiscence|anecdote|recollection|personal\s+narrative|true\s+crime|histor(?:y|ies|ical)|military|expedition|exploration|explorer|travel(?:\s+writing|\s+accounts?|\s+narratives?)?"),
    ("practical", r"self.help|self\s+improvement|personal\s+development|motivational|cooking|recipes?|cookbook|food\s+and\s+wine|gardening|horticulture|craft|sewing|knitting|needlework|farming|agriculture|husbandry|household|housekeeping|home\s+improvement|parenting|childcare|child\s+rearing|health|fitness|nutrition|diet|wellness|exercise|relationships|dating|career|job\s+hunting|manual|handbook|reference|almanac|dictionary|encyclopedia|guide|test\s+prep"),
)
DEFAULT_CATEGORY = "dramatic"

ACTIONS = ("worship", "praise", "glorify", "glorifies", "hail", "celebrate", "celebrates", "revel", "embrace", "serve", "devote", "honor", "adore", "invoke", "summon", "extol")
OCCULT = ("satan", "devil", "lucifer", "demon", "demonic", "occult", "infernal", "hell")
VIOLENCE = ("violence", "violent", "gore", "gory", "gruesome", "grisly", "bloodshed", "blood-soaked", "mutilation", "dismemberment", "torture", "decapitation", "beheading", "evisceration")
GAP_WORDS = 4


def near(a: Iterable[str], b: Iterable[str], gap: int = GAP_WORDS) -> str:
    """A pattern for a word of ``a`` and a word of ``b`` with at most ``gap`` words between, in either order."""
    x, y, between = "|".join(a), "|".join(b), rf"(?:\W+\w+){{0,{gap}}}\W+"
    return rf"\b(?:{x})\b{between}\b(?:{y})\b|\b(?:{y})\b{between}\b(?:{x})\b"


# Fixed values: (name, pattern, words one of which every match of the pattern has; None: the rule is for metadata only).
TOPIC_RULES: tuple[tuple[str, str, tuple[str, ...] | None], ...] = (
    ("erotic", r"\b(?:erotic|erotica|eroticism)\b", None),
    ("gory-violence", r"\b(?:gore|gory|gruesome|grisly|graphic violence|slasher|splatter|mutilat(?:e|ed|ion|ions)|dismember(?:ed|ment|ments)?|eviscerat(?:e|ed|ion|ions)|decapitat(?:e|ed|ion|ions)|behead(?:ed|ing|ings)?|tortur(?:e|ed|ing|er|ers)?|blood[- ]soaked)\b", ("gore", "gory", "gruesome", "grisly", "graphic violence", "slasher", "splatter", "mutilat", "dismember", "eviscerat", "decapitat", "behead", "tortur", "blood")),
    ("psychic", r"\b(?:psychic|psychics|psychical)\b", None),
    ("mahabharata", r"\b(?:mahabharata|mahābhārata)\b", None),
    ("occult-intent", near(ACTIONS, OCCULT), OCCULT),
    ("violence-intent", near(ACTIONS, VIOLENCE), VIOLENCE),
    ("bible-attack", r"\b(?:gnostic bible|gnostic gospels?|anti[- ]?bible|against the bible|attacking the bible|attack(?:ing)? on the bible|bible criticism|criticism of the bible|anti[- ]?christian|bible is false|attack(?:ing)? christianity)\b", ("gnostic", "bible", "christian")),
)


def category_strict(subjects: Column) -> Column:
    """The first category with a matching word among the subjects, or null."""
    joined, out = F.array_join(F.coalesce(subjects, F.array().cast("array<string>")), " | "), None
    for name, words in CATEGORIES:
        test = joined.rlike(rf"(?iU)\b(?:{words})\b")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def category_of(subjects: Column) -> Column:
    return F.coalesce(category_strict(subjects), F.lit(DEFAULT_CATEGORY))


def category_cascade(stored: Column, subjects: Column, summary: Column) -> Column:
    """A stored category, else by subjects, else by the summary, else the default."""
    return F.coalesce(stored, category_strict(subjects), category_strict(F.array(F.coalesce(summary, F.lit("")))), F.lit(DEFAULT_CATEGORY))


def category_word(answer: Column) -> Column:
    """The category that a model's answer names first."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?i)\b(dramatic|biographical|analytical|practical)\b", 1)), F.lit(""))


def topics(blob: Column, rules=TOPIC_RULES) -> Column:
    """Names of the rules that a text matches."""
    return F.filter(F.array(*[F.when(blob.rlike("(?iU)" + p), F.lit(name)) for name, p, _ in rules]), lambda r: r.isNotNull())


def text_prefilter(text: Column, rules=TOPIC_RULES) -> Column:
    """A cheap test that every match of the rules for texts passes; the optimizer can't derive it."""
    words = sorted({w for _, _, needed in rules if needed for w in needed})
    return F.lower(text).rlike("|".join(words))


def scan_topics(meta: DataFrame, bodies: DataFrame, key: str = "bookid", prefilter: bool = True) -> DataFrame:
    """key, reasons and found_in: all rules over metadata (title, subjects, summary), then the rules for texts over the bodies of the rest.

    Bodies are read only for books that metadata left open.
    """
    blob = F.concat_ws(" \n ", "title", F.array_join("subjects", " | "), "summary")
    by_meta = meta.select(key, topics(blob).alias("reasons")).where(F.size("reasons") > 0).withColumn("found_in", F.lit("metadata"))
    for_text = [r for r in TOPIC_RULES if r[2]]
    rest = bodies.join(by_meta.select(key), key, "left_anti")
    rest = rest.where(text_prefilter(F.col("clean_content"))) if prefilter else rest
    by_text = rest.select(key, topics(F.col("clean_content"), for_text).alias("reasons")).where(F.size("reasons") > 0).withColumn("found_in", F.lit("text"))
    return by_meta.unionByName(by_text)
