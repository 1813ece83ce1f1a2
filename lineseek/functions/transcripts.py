"""Reading a speech recogniser's JSON answer as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineseek.functions.text import strip

# The default language and the one tried after it.
DEFAULT_LANGUAGE = "en-US"
FALLBACK_LANGUAGE = "en-GB"
# Fixed value: reported when no language gave a usable transcript.
NOT_RECOGNIZED_MESSAGE = (
    "Speech was not recognized. Try speaking clearly for 1-2 seconds and "
    "keep the microphone close."
)


def _first_usable(transcripts: Column) -> Column:
    stripped = F.transform(transcripts, lambda item: strip(F.coalesce(item, F.lit(""))))
    return F.coalesce(F.get(F.filter(stripped, lambda item: item != ""), F.lit(0)), F.lit(""))


def _texts(array_json: Column) -> Column:
    """Transcripts of a JSON array: an object's `transcript`, or the item itself."""
    items = F.from_json(array_json, "array<string>")
    return F.transform(
        items,
        lambda item: F.when(
            F.startswith(F.ltrim(item), F.lit("{")), F.get_json_object(item, "$.transcript")
        ).otherwise(item),
    )


def best_transcript(response: Column) -> Column:
    """First alternative, in given order, whose stripped transcript is not empty.

    The response is JSON text: an object with `alternative`, a bare array, or a
    string. Confidence plays no part. Nothing usable gives ''.
    """
    text = F.ltrim(response)
    of_object = _first_usable(_texts(F.get_json_object(response, "$.alternative")))
    of_array = _first_usable(_texts(response))
    of_string = strip(F.get_json_object(F.concat(F.lit('{"s":'), response, F.lit("}")), "$.s"))
    return F.coalesce(
        F.when(F.startswith(text, F.lit("{")), of_object)
        .when(F.startswith(text, F.lit("[")), of_array)
        .when(F.startswith(text, F.lit('"')), of_string),
        F.lit(""),
    )
