"""Text queries over whole documents."""

from pyspark.sql import functions as F

from lodestone.operators import text
from lodestone.operators.order import top_n
from lodestone.plans.registry import query
from lodestone.sources import spread


def _documents(t):
    return spread(t("documents"))


_WORDS = "list_filter(list_transform(string_split_regex({}, '[ \\t\\n\\r]+'), lambda w: regexp_replace(w, '[,.;]$', '')), lambda w: length(w) >= {})"
_COUNTS = f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text', 3)}) AS word FROM documents) GROUP BY word"


@query(_COUNTS)
def word_count(t):
    return text.word_count(_documents(t), min_length=3)


@query(f"SELECT word, n FROM ({_COUNTS}) ORDER BY n DESC, word LIMIT 50")
def sorted_word_count_topn(t):
    return text.sorted_word_count(_documents(t), min_length=3).limit(50)


@query(f"SELECT word, n FROM ({_COUNTS.replace('>= 3', '>= 1')}) ORDER BY n, word LIMIT 50")
def sorted_word_count_ascending(t):
    return text.sorted_word_count(_documents(t), ascending=True).limit(50)


@query(f"SELECT word, n FROM ({_COUNTS.replace('>= 3', '>= 1')}) ORDER BY n, word")
def sorted_word_count_whole(t):
    return text.sorted_word_count(_documents(t), ascending=True)


@query(f"""SELECT word, string_agg(n || ':' || source, ',' ORDER BY n, source) AS postings FROM (
  SELECT source, word, count(*) AS n FROM (SELECT source, unnest({_WORDS.format('text', 3)}) AS word FROM documents) GROUP BY ALL) GROUP BY word""")
def doc_word_postings(t):
    out = text.word_postings(_documents(t), "source", "text", 3)
    return out.select("word", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["n"], p["doc"])), ",").alias("postings"))


_CHARS = "SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all({}, '(?s).')) AS ch FROM documents) GROUP BY ch"


@query(_CHARS.format("lower(text)"))
def char_count(t):
    return text.char_count(_documents(t))


@query(_CHARS.format("text"))
def char_count_by_character(t):
    return text.char_count(_documents(t), lower=False, local=False)


@query("""SELECT base, count(*) AS n FROM (SELECT CASE WHEN c IN ('A','C','G','T') THEN c ELSE 'other' END AS base FROM (
  SELECT unnest(regexp_extract_all(translate(trim(l), 'acgt', 'ACGT'), '(?s).')) AS c FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l NOT LIKE '>%')) GROUP BY base""")
def base_count(t):
    return text.base_count(_documents(t).select(F.explode(F.split("text", "\n")).alias("value")))


@query("""SELECT kmer, count(*) AS n FROM (SELECT c[i] || c[i + 1] || c[i + 2] AS kmer FROM (
  SELECT c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT regexp_extract_all(text, '(?s).') AS c FROM documents))) GROUP BY kmer ORDER BY n DESC, kmer LIMIT 20""")
def kmer_topn(t):
    return top_n(text.kmers(_documents(t), "text", 3), 20, "n", "kmer")


@query(r"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[ \t\n\r]+'), lambda x: regexp_replace(x, '[^A-Za-z0-9_]', '', 'g')), lambda x: x <> '') AS t FROM documents),
p AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM w), n AS (SELECT t[i] AS word, t[j] AS neighbour FROM (SELECT t, i, unnest(range(greatest(i - 2, 1), least(i + 2, len(t)) + 1)) AS j FROM p) WHERE i <> j),
c AS (SELECT word, neighbour, count(*) AS n FROM n GROUP BY ALL)
SELECT word, neighbour, n, (sum(n) OVER (PARTITION BY word))::BIGINT AS total, round(n / sum(n) OVER (PARTITION BY word), 9) AS frequency FROM c""")
def relative_frequency_w2(t):
    tokens = F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z0-9_ \t\n\r]", ""), r"[ \t\n\r]+"), lambda w: w != "")
    return text.relative_frequency(_documents(t), tokens, 2).withColumn("frequency", F.round("frequency", 9))


_LETTERS = "list_sort(regexp_extract_all(word, '(?s).'))"
_ANAGRAMS = f"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('lower(text)', 2)}) AS word FROM documents) GROUP BY word)
SELECT array_to_string({_LETTERS}, '') AS letters, string_agg({{}}, ',' ORDER BY word) AS words FROM c GROUP BY ALL HAVING count(*) > 1"""


@query(_ANAGRAMS.format("word"))
def anagram_groups(t):
    return text.anagrams(_documents(t)).select("letters", F.array_join("words", ",").alias("words"))


@query(_ANAGRAMS.format("word || ':' || n"))
def anagram_counts(t):
    pairs = F.zip_with("words", "counts", lambda w, n: F.concat_ws(":", w, n))
    return text.anagrams(_documents(t)).select("letters", F.array_join(pairs, ",").alias("words"))
