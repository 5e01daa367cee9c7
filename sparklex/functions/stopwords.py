"""Stop-word lists by language: those that ship with Spark's machine-learning library, or the public ones from a file."""

from __future__ import annotations

from pyspark.sql import SparkSession

LANGUAGES = {"en": "english", "fr": "french", "de": "german", "it": "italian", "pt": "portuguese", "es": "spanish"}


def stop_words(spark: SparkSession, language: str) -> tuple[str, ...]:
    """The list of a language, for ``Analyzer(stop_words=...)``; any other list can be given there as well."""
    if language not in LANGUAGES:
        raise ValueError(f"there is no list for {language}; the languages are {sorted(LANGUAGES)}")
    remover = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover
    return tuple(sorted(set(remover.loadDefaultStopWords(LANGUAGES[language]))))


#: The sizes of the public lists that the vectorizers are commonly used with (English: the list of 318
#: words; the others: the Snowball project's lists). The lists themselves are read from the user's files.
PUBLIC_SIZES = {"en": 318, "fr": 154, "de": 231, "pt": 203, "es": 308}


def read_stop_words(spark: SparkSession, path: str, language: str | None = None) -> tuple[str, ...]:
    """The words of a file, one a line, what follows a ``|`` being a comment. With ``language`` the number of distinct
    words must be that of the public list."""
    words = tuple(sorted({w for r in spark.read.text(path).collect() if (w := r[0].split("|")[0].strip())}))
    if language is not None and len(words) != PUBLIC_SIZES[language]:
        raise ValueError(f"{path} has {len(words)} words; the public list of {language} has {PUBLIC_SIZES[language]}")
    return words
