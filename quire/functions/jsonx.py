"""Functions on JSON text: genres, reading positions, keys of runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_MAP = "map<string,string>"


def genres(value: Column) -> Column:
    """Names of genres: values of an object in order, entries of a list, or the text itself."""
    v = F.trim(F.coalesce(value, F.lit("")))
    as_map, as_list = F.from_json(v, ANY_MAP), F.from_json(v, "array<string>")
    return F.when(v == "", F.array().cast("array<string>")).when(v.startswith("{") & as_map.isNotNull(), F.array_sort(F.map_values(as_map))).when(v.startswith("[") & as_list.isNotNull(), as_list).otherwise(F.array(v))


def position_map(value: Column) -> Column:
    """A reading position as a map; what is no object gives an empty one."""
    return F.coalesce(F.when(F.trim(value).startswith("{"), F.from_json(value, ANY_MAP)), F.create_map().cast(ANY_MAP))


def canonical_position(value: Column) -> Column:
    """Sorted keys and no white space; text that is no JSON object is kept under ``raw``."""
    m = F.from_json(value, ANY_MAP)
    entries = F.array_sort(F.map_entries(m))
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit("{}")).when(F.trim(value).startswith("{") & m.isNotNull(), F.to_json(F.map_from_entries(entries))).otherwise(F.to_json(F.create_map(F.lit("raw"), value)))


def run_key(ids: Column, length: int = 12) -> Column:
    """A key of a set of ids: the head of the SHA-1 of their sorted list."""
    return F.substring(F.sha1(F.array_join(F.array_sort(ids), ",").cast("binary")), 1, length)


def resume_label(media_type: Column, position: Column) -> Column:
    """Where to go on: chapter of a text; track and time of audio."""
    number = lambda *names: F.coalesce(*[F.expr("try_cast(null as int)")], *[position[n].try_cast("int") for n in names], F.lit(0))
    seconds = F.coalesce(position["current_time"].try_cast("double"), F.lit(0.0))
    from .text import minutes_seconds

    return F.when(media_type == "text", F.concat(F.lit("Chapter "), (number("selected_text_index") + 1).cast("string"))).otherwise(F.concat(F.lit("Track "), (number("selected_audio_index", "track_order") + 1).cast("string"), F.lit(" · "), minutes_seconds(seconds)))
