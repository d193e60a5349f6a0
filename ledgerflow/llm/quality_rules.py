"""Line-first cleaning: rules per line, and documents that lose too much text to them are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.shared import slices, texts_of
from ledgerflow.llm.words import count_of, hashes, repeated_words

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: A line may end so.
ENDINGS = tuple(".!?:;\"')]}…”’»。！？")
#: Phrases of pages' furniture by language, letters beyond ASCII as a dot; all are looked for in every line, whatever its language.
PHRASES = {
    "en": "cookies?|privacy policy|terms of (?:use|service)|all rights reserved|sign (?:in|up)|log ?in|subscribe|newsletter|click here|read more|javascript|lorem ipsum|powered by|share (?:on|this)|skip to|copyright",
    "de": "datenschutz(?:erkl.rung)?|impressum|nutzungsbedingungen|alle rechte vorbehalten|anmelden|abonnieren|hier klicken|weiterlesen|mehr lesen|zum inhalt springen",
    "es": "pol.tica de privacidad|aviso legal|t.rminos de uso|todos los derechos reservados|iniciar sesi.n|suscr.bete|haga clic|leer m.s",
    "fr": "politique de confidentialit|mentions l.gales|conditions d.utilisation|tous droits r.serv.s|se connecter|abonnez-vous|cliquez ici|lire la suite",
    "it": "informativa sulla privacy|note legali|tutti i diritti riservati|clicca qui|leggi tutto",
    "pt": "pol.tica de privacidade|termos de uso|todos os direitos reservados|clique aqui|leia mais",
}
FURNITURE = rf"\b(?:{'|'.join(PHRASES.values())})\b|©"
BOILERPLATE = re.compile(FURNITURE, re.IGNORECASE | re.ASCII)
BOILERPLATE_WORDS = 25
#: Addresses; a line is navigation if half its words are such.
LINKS = r"[hH][tT][tT][pP][sS]?://|[wW][wW][wW][.]"
LINK = re.compile(LINKS)
#: Lines with fewer words need an ending; longer ones may lack it.
SHORT_WORDS = 10


def line_fails(line: str) -> str | None:
    """The rule that a line with words breaks: navigation, punctuation or boilerplate."""
    data = line.encode("utf-8", "surrogatepass")
    n = len(data.split())
    bars = line.count("|") + line.count(">") + line.count("»") + line.count("•")
    if bars >= 2 and 3 * bars >= n or ("://" in line or "." in line) and 2 * len(LINK.findall(line)) >= max(n, 1):
        return "navigation"
    if n >= 3 and (3 * count_of(data, SYMBOLS) >= n or 3 * line.count("!") >= 2 * n):
        return "punctuation"
    if n < SHORT_WORDS and not line.rstrip(BLANKS.decode()).endswith(ENDINGS):
        return "punctuation"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    return None


RESULT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long, cleaned string"
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def judge(text: str, most_lost: float = 0.5) -> tuple:
    """All of RESULT but the id."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    parts = text.split("\n")
    own = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(hashes.of(words)) if n > 8 else 0
    base = n < 20 or 100 * repeats > 30 * n
    kept, lost, verdicts = [], 0, {}
    for line in parts:
        if line not in verdicts:
            verdicts[line] = bool(line.strip(BLANKS.decode())) and line_fails(line) is not None
        if verdicts[line]:
            lost += len(line.encode("utf-8", "surrogatepass").split())
        else:
            kept.append(line)
    return n, len(text) - count_of(data, BLANKS), count_of(data, SYMBOLS), len(own) - len(set(own)), repeats, base, not base and lost <= most_lost * n, len(parts) - len(kept), lost, "\n".join(kept)


def clean_lines(docs: DataFrame, most_lost: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document its counts, whether it is kept, and its text without the lines that break a rule.

    A document is kept if the base rules hold (20 words, at most 30 in 100 words in repeated runs of eight) and the lines removed have at most `most_lost` of
    its words. Null and empty texts have no words and fail the base; null ids stay null; repeated rows are judged each for itself; an empty table gives no
    rows; other columns aren't read. A text is in memory once at a time, and batches of very long ones are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [judge(t, most_lost) for t in texts_of(batch, "text")]
            columns = [batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, RESULT)


def op7_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cleaned").withColumnRenamed("id", "doc_id")


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op7_line_first_cleaning": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(1)) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT doc_id, run FROM windows GROUP BY doc_id, run HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT v.doc_id, unnest(range(v.i, v.i + 8)) AS place FROM windows v JOIN twice t ON v.doc_id = t.doc_id AND v.run = t.run) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
counted AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '{_WORD}')) AS n, len(regexp_extract_all(line, '{LINKS}')) AS links, length(line) - length(regexp_replace(line, '[|>»•]', '', 'g')) AS bars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, length(line) - length(replace(line, '!', '')) AS marks,
    regexp_matches(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(?:{"|".join(re.escape(c) for c in ENDINGS).replace("'", "''")})$') AS ended, regexp_matches(line, '(?i){FURNITURE}') AS phrase
  FROM lines
), judged AS (
  SELECT *, n > 0 AND (bars >= 2 AND 3 * bars >= n OR 2 * links >= n OR n >= 3 AND (3 * symbols >= n OR 3 * marks >= 2 * n) OR n < {SHORT_WORDS} AND NOT ended OR n <= {BOILERPLATE_WORDS} AND phrase) AS fails FROM counted
), by_doc AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(n) FILTER (fails), 0) AS n_words_removed FROM judged GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed
  FROM words LEFT JOIN covered USING (doc_id) JOIN by_doc USING (doc_id)
), verdict AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words_removed <= 0.5 * n_words AS kept FROM verdict
"""
}
