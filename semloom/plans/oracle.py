"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_URL = r"https?://\S+"
_MESSAGES = """messages AS (
    SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id, turn, role, text AS content FROM conversations)"""
_KEPT = f"""{_MESSAGES}, kept AS (
    SELECT id, role, content FROM messages
    WHERE length(content) > 0 AND NOT (content ILIKE '[SYSTEM:%' OR content ILIKE '[CONTEXT COMPACTION%') AND role IN ('assistant', 'user'))"""


def _tokens(text: str) -> str:
    """The word list of a text, for texts of scripts with spaces."""
    words = rf"regexp_extract_all(regexp_replace(lower({text}), '{_URL}', ' ', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''\-=]*')"
    coded = "(length(w) >= 20 AND regexp_full_match(w, '[\\x00-\\x7F]*') AND NOT regexp_matches(w, '[aeiou]'))"
    kept = f"list_filter({words}, lambda w: length(w) BETWEEN 2 AND 25 AND right(w, 1) <> '=' AND NOT {coded})"
    return f"list_transform({kept}, lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '<NUM>' ELSE w END)"


_SENTENCES = rf"""{_KEPT}, pieces AS (
    SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS sentence
    FROM (SELECT id, regexp_split_to_array(content, '[.!?\n]+') AS p FROM kept)),
sentences AS (SELECT * FROM (SELECT id, sentence, {_tokens("piece")} AS words FROM pieces) WHERE len(words) >= 3),
tokens AS (SELECT id, sentence, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS position FROM sentences),
running AS (SELECT *, count(*) OVER (PARTITION BY word ORDER BY id, sentence RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM tokens),
live AS (SELECT *, row_number() OVER (PARTITION BY id, sentence ORDER BY position) AS place FROM running WHERE so_far >= 2)"""

_TERMS = r"""split AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS terms FROM documents),
lengths AS (SELECT id, len(terms) AS length FROM split),
places AS (SELECT id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS position FROM split),
size AS (SELECT count(*) AS documents, avg(length) AS average FROM lengths)"""


def _bm25(phrases: list[str], condition: str) -> str:
    """``phrases``: selects of (id, tf); ``condition``: over the hits p0, p1, ... of an id."""
    n = range(len(phrases))
    ctes = ", ".join(f"p{i} AS ({phrases[i]})" for i in n)
    parts = " UNION ALL ".join(f"SELECT id, tf, (SELECT count(*) FROM p{i}) AS n FROM p{i}" for i in n)
    return f"""WITH {_TERMS}, {ctes}, parts AS ({parts}), hits AS ({condition}),
weighted AS (SELECT id, tf, ln((documents - n + 0.5) / (n + 0.5)) AS w, length, average FROM parts JOIN hits USING (id) JOIN lengths USING (id), size)
SELECT id, round(sum(-(CASE WHEN w <= 0 THEN 1e-6 ELSE w END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score FROM weighted GROUP BY id"""


def _word(term: str) -> str:
    return f"SELECT id, count(*) AS tf FROM places WHERE term = '{term}' GROUP BY id"


_TWO = """rows AS (SELECT doc_id, source, n_chars, len(string_split(text, ' ')) AS blanks FROM documents),
lists AS (
    SELECT source, 0 AS list, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank, doc_id AS id FROM rows
    UNION ALL SELECT source, 1, row_number() OVER (PARTITION BY source ORDER BY blanks DESC, doc_id) - 1, doc_id FROM rows),
fused AS (
    SELECT source, id, sum(1.0 / (rank + 61)) AS score, min(list * 100 + rank) AS came FROM lists WHERE rank < 20 GROUP BY source, id),
trust AS (SELECT d.doc_id AS id, d.text, coalesce(0.5 + 0.05 * quality - 0.10 * toxic, 0.5) AS trust FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_KINDS = {"fts_and": ["the", "with"], "fts_or": ["idiot", "clown"], "fts_not": ["that", "with"]}


def oracle_sql() -> dict[str, str]:
    both = {k: [_word(w) for w in v] for k, v in _KINDS.items()}
    top = f"""SELECT id, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY score, id) - 1 AS INTEGER) AS rank FROM ({
        _bm25([_word(w) for w in ("idiot", "clown", "trash")], "SELECT id FROM p0 UNION SELECT id FROM p1 UNION SELECT id FROM p2").replace("round(", "(").replace(", 6) AS score", ") AS score")
    }) ORDER BY score, id LIMIT 20"""
    return {
        "session_messages": f"WITH {_KEPT} SELECT id, role, content FROM kept",
        "highest_message": f"WITH {_MESSAGES} SELECT coalesce(max(id), 0) AS highest FROM messages",
        "messages_since": f"WITH {_KEPT} SELECT id, content FROM kept WHERE id > 300",
        "chat_blocks": "SELECT conv_id, turn, text FROM conversations WHERE role IN ('user', 'assistant')",
        "sentence_pieces": r"SELECT doc_id AS id, CAST(len(regexp_split_to_array(text, '[.!?\n]+')) AS INTEGER) AS pieces FROM documents",
        "corpus_sentences": f"WITH {_SENTENCES} SELECT id, CAST(sentence AS INTEGER) AS sentence, array_to_string(words, ' ') AS words FROM sentences",
        "token_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS word FROM documents) GROUP BY word",
        "vocabulary": f"""WITH {_SENTENCES}, first AS (SELECT word, min((id, sentence, position)) AS came FROM live GROUP BY word),
            numbered AS (SELECT word, row_number() OVER (ORDER BY came) - 1 AS idx FROM first)
            SELECT word, count(*) AS count, any_value(idx) AS idx FROM tokens LEFT JOIN numbered USING (word) GROUP BY word""",
        "cooccurrences": f"""WITH {_SENTENCES} SELECT a.word, b.word AS neighbour, count(*) AS n FROM live a JOIN live b
            ON a.id = b.id AND a.sentence = b.sentence AND a.place <> b.place AND abs(a.place - b.place) <= 3 GROUP BY a.word, b.word""",
        "identity_numbers": f"""WITH {_SENTENCES}, words AS (SELECT DISTINCT word FROM tokens), blocks AS (
            SELECT word, list_transform(range(128), lambda b: sha256(word || ':' || b)) AS hashes FROM words)
            SELECT word, md5(array_to_string(flatten(list_transform(hashes, lambda h: list_transform(range(16), lambda i:
                CAST(('0x' || substr(h, CAST(i * 4 + 3 AS INTEGER), 2) || substr(h, CAST(i * 4 + 1 AS INTEGER), 2)) AS INTEGER)))), ' ')) AS numbers FROM blocks""",
        "idf": f"""WITH seen AS (SELECT unnest(list_distinct({_tokens('text')})) AS word FROM documents)
            SELECT word, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM seen GROUP BY word""",
        "postings": f"WITH {_TERMS} SELECT term, id, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ' ' ORDER BY position) AS positions, CAST(any_value(length) AS INTEGER) AS length FROM places JOIN lengths USING (id) GROUP BY term, id",
        "fts_and": _bm25(both["fts_and"], "SELECT id FROM p0 INTERSECT SELECT id FROM p1"),
        "fts_or": _bm25(both["fts_or"], "SELECT id FROM p0 UNION SELECT id FROM p1"),
        "fts_not": _bm25(both["fts_not"], "SELECT id FROM p0 EXCEPT SELECT id FROM p1"),
        "fts_phrase": _bm25(["SELECT a.id, count(*) AS tf FROM places a JOIN places b ON a.id = b.id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id"], "SELECT id FROM p0"),
        "fts_prefix": _bm25(["SELECT id, count(*) AS tf FROM places WHERE term LIKE 'wor%' GROUP BY id"], "SELECT id FROM p0"),
        "fts_initial": _bm25(["SELECT id, count(*) AS tf FROM places WHERE term = 'the' AND position = 0 GROUP BY id"], "SELECT id FROM p0"),
        "fts_near": _bm25([_word("from"), _word("with")], "SELECT DISTINCT a.id FROM places a JOIN places b ON a.id = b.id AND abs(a.position - b.position) <= 4 WHERE a.term = 'from' AND b.term = 'with'"),
        "fts_top": top,
        "nearest_vectors": """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), best AS (
            SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 20)
            SELECT id, round(score, 4) AS score FROM best WHERE score > 0.01""",
        "label_cosines": """WITH cells AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
            means AS (SELECT label, list(x ORDER BY i) AS mean FROM cells GROUP BY label)
            SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.mean, b.mean), 5) AS cosine FROM means a JOIN means b ON a.label < b.label""",
        "rank_fusion": f"""WITH {_TWO} SELECT source, id, round(score, 8) AS score,
            CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, came) - 1 AS INTEGER) AS place FROM fused""",
        "trusted_search": f"""WITH {_TWO}, placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, came) - 1 AS place FROM fused)
            SELECT source, id, CAST(place AS INTEGER) AS place, round(score * trust, 8) AS score, CAST(round(trust, 4) AS DOUBLE) AS trust FROM placed JOIN trust USING (id) WHERE place < 5""",
        "trusted_lines": f"""WITH {_TWO}, scored AS (SELECT source, text, trust, came, round(score * trust, 9) AS score FROM fused JOIN trust USING (id)),
            placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, came) AS INTEGER) AS place FROM scored)
            SELECT source, place, format('- [{{:.4f}} trust:{{:.1f}}] {{}}', score, trust, substr(text, 1, 200)) AS line FROM placed WHERE place <= 5""",
        "feedback": """WITH start AS (SELECT d.doc_id, l.quality, l.toxic, coalesce(0.5 + 0.05 * quality - 0.10 * toxic, 0.5) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
            once AS (SELECT *, CASE WHEN quality IS NULL THEN t WHEN quality = 1 THEN least(1.0, t + 0.05) ELSE greatest(0.0, t - 0.10) END AS u FROM start)
            SELECT doc_id AS fact_id, CAST(round(CASE WHEN toxic IS NULL THEN u WHEN toxic = 1 THEN greatest(0.0, u - 0.10) ELSE least(1.0, u + 0.05) END, 4) AS DOUBLE) AS trust FROM once""",
        "removed_facts": "SELECT doc_id AS fact_id, CAST(length(text) AS INTEGER) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "repeated_facts": "SELECT min(doc_id) AS fact_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
        "imported_trust": """SELECT CAST(round(CASE WHEN quality IS NULL OR quality = 0 THEN 0.5 ELSE quality * 0.8 END, 3) AS DOUBLE) AS trust, count(*) AS n
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL GROUP BY 1""",
    }
