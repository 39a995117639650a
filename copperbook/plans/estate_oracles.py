"""SQL equivalents of the estate queries.

These follow the order of lines with window functions, where the operators
work inside the row of a file; the two have no step in common.
"""

from copperbook.sources.estate_from_parts import estate_sql
from copperbook.vocabulary import (
    BULL_WORDS,
    CICS_CLASSES,
    DIALECT_RULES,
    DIALECTS,
    EXEC_KINDS,
    FIGURATIVE,
    NEC_WORDS,
    ONE_WORD_TYPES,
    SQL_CLASSES,
    STATEMENT_TYPES,
    TERMINATORS,
    TWO_WORD_TYPES,
    UNCONVERTED_TYPES,
    USAGE_WORDS,
    VERBS,
)


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LINES = f"""
sources AS ({estate_sql()}),
raw AS (
  SELECT path, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS line_no
  FROM (SELECT path, regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n)$', ''), '\\r\\n|\\n') AS l FROM sources)),
cols AS (
  SELECT path, line_no,
    CASE WHEN length(raw) < 7 THEN 'code' WHEN substr(raw, 7, 1) IN ('*', '/', 'D', 'd') THEN 'comment'
         WHEN substr(raw, 7, 1) = '-' THEN 'continuation' ELSE 'code' END AS kind,
    trim(CASE WHEN length(raw) < 7 THEN raw WHEN substr(raw, 7, 1) = '-' THEN substr(raw, 8, 65)
              ELSE substr(raw, 7, 66) END) AS content
  FROM raw),
kept AS (
  SELECT *, sum(CASE WHEN kind = 'code' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS g
  FROM cols WHERE kind <> 'comment' AND content <> ''),
fixed AS (
  SELECT path, min(line_no) AS n, string_agg(content, ' ' ORDER BY line_no) AS content
  FROM kept WHERE g > 0 GROUP BY path, g),
free AS (
  SELECT path, line_no AS n, trim(raw) AS content FROM raw
  WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '*>%'),
usable AS (SELECT path FROM fixed GROUP BY path HAVING max(length(content)) >= 3),
lines AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY n) AS line_no, content
  FROM (SELECT * FROM fixed WHERE path IN (SELECT path FROM usable)
        UNION ALL SELECT * FROM free WHERE path NOT IN (SELECT path FROM usable)))"""

_TAGS = _LINES + """,
headed AS (
  SELECT *, upper(content) AS u,
    CASE WHEN contains(upper(content), 'IDENTIFICATION DIVISION') OR contains(upper(content), 'ID DIVISION') THEN 'IDENTIFICATION'
         WHEN contains(upper(content), 'ENVIRONMENT DIVISION') THEN 'ENVIRONMENT'
         WHEN contains(upper(content), 'DATA DIVISION') THEN 'DATA'
         WHEN contains(upper(content), 'PROCEDURE DIVISION') THEN 'PROCEDURE' END AS dh,
    nullif(regexp_extract(upper(content), '(WORKING-STORAGE|LOCAL-STORAGE|LINKAGE|FILE|SCREEN|REPORT|COMMUNICATION) SECTION', 1), '') AS sh
  FROM lines),
divided AS (
  SELECT *, coalesce(last_value(dh IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no), '') AS division FROM headed),
tagged AS (
  SELECT path, line_no, content, u, dh, sh, division,
    CASE WHEN division = 'DATA'
         THEN coalesce(last_value(sh IGNORE NULLS) OVER (PARTITION BY path, division ORDER BY line_no), '')
         ELSE '' END AS data_section
  FROM divided)"""

# Sentences of the data sections.
_DATA = _TAGS + """,
data_lines AS (
  SELECT path, line_no, content, u, data_section AS section,
    CASE WHEN data_section = 'FILE'
         THEN last_value(CASE WHEN u LIKE 'FD %' THEN rtrim(regexp_extract(u, '^FD\\s+(\\S+)', 1), '.') END IGNORE NULLS)
              OVER (PARTITION BY path, data_section ORDER BY line_no) ELSE '' END AS fd
  FROM tagged
  WHERE division = 'DATA' AND dh IS NULL AND sh IS NULL AND data_section NOT IN ('', 'REPORT', 'COMMUNICATION')),
data_marked AS (
  SELECT *, CASE WHEN u LIKE 'EXEC %' THEN 1 ELSE 0 END AS opens, CASE WHEN contains(u, 'END-EXEC') THEN 1 ELSE 0 END AS closes
  FROM data_lines WHERE fd IS NOT NULL AND u NOT LIKE 'FD %'),
data_state AS (
  SELECT *, coalesce(sum(opens - closes) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside,
    lag(content) OVER (PARTITION BY path, section, fd ORDER BY line_no) AS prev
  FROM data_marked),
data_starts AS (
  SELECT *, CASE WHEN inside > 0 THEN 0
                 WHEN prev IS NULL OR opens = 1 OR u LIKE 'COPY %' OR prev LIKE '%.' OR contains(upper(prev), 'END-EXEC')
                      OR upper(prev) LIKE 'COPY %' THEN 1 ELSE 0 END AS starts
  FROM data_state),
data_groups AS (
  SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line_no) AS g FROM data_starts),
data_sentences AS (
  SELECT path, g, min(line_no) AS line_no, min(section) AS section, min(fd) AS fd,
    string_agg(content, ' ' ORDER BY line_no) AS sentence
  FROM data_groups GROUP BY path, g),
item_text AS (
  SELECT path, section, fd, row_number() OVER (PARTITION BY path ORDER BY line_no) AS item_no,
    trim(rtrim(sentence, '.')) AS s
  FROM data_sentences WHERE regexp_matches(sentence, '^\\d{1,2}\\s+\\S')),
item_parts AS (
  SELECT path, section, fd, item_no, CAST(regexp_extract(s, '^(\\d{1,2})', 1) AS BIGINT) AS level,
    rtrim(regexp_extract(s, '^\\d{1,2}\\s+(\\S+)', 1), '.') AS name,
    rtrim(regexp_extract(s, '^\\d{1,2}\\s+\\S+(.*)$', 1), '.') AS clauses
  FROM item_text)"""

def _after(keys, optional, column="cw", skip_is=False):
    """SQL for the word after the first of the keywords, by its place in a list."""
    at = "coalesce(" + ", ".join(f"nullif(list_position(cu, '{k}'), 0)" for k in keys) + ")"
    step = f"(CASE WHEN cu[{at} + 1] IN ({', '.join(repr(o) for o in optional)}) THEN 1 ELSE 0 END)" if optional else "0"
    if skip_is:
        step = f"({step} + CASE WHEN cu[{at} + 1 + {step}] = 'IS' THEN 1 ELSE 0 END)"
    return f"coalesce({column}[{at} + 1 + {step}], '')"


_LITERAL_TEXT = """CASE WHEN {v} LIKE '"%"' AND length({v}) > 1 THEN replace({v}[2:-2], '""', '"')
      WHEN {v} LIKE '''%''' AND length({v}) > 1 THEN replace({v}[2:-2], '''''', '''') ELSE trim({v}, '"''') END"""

_ITEMS = _DATA + f""",
item_raw AS (
  SELECT *, CASE WHEN level = 88 THEN '' ELSE clauses END AS c FROM item_parts),
item_words AS (
  SELECT *, list_transform(cw, lambda x: upper(x)) AS cu
  FROM (SELECT *, regexp_extract_all(c, '[A-Za-z]*"[^"]*(?:""[^"]*)*"|[A-Za-z]*''[^'']*(?:''''[^'']*)*''|[^ ]+') AS cw FROM item_raw)),
item_clauses AS (
  SELECT *,
    rtrim({_after(['PIC', 'PICTURE'], ['IS'])}, '.') AS picture,
    upper(rtrim({_after(['USAGE'], ['IS'])}, '.')) AS use1,
    coalesce(list_filter(cu, lambda x: regexp_full_match(x, '{USAGE_WORDS}'))[1], '') AS use2,
    rtrim(CASE WHEN {_after(['VALUE', 'VALUES'], ['IS', 'ARE'], 'cu')} = 'ALL'
      THEN 'ALL ' || cw[list_position(cu, 'ALL') + 1] ELSE {_after(['VALUE', 'VALUES'], ['IS', 'ARE'])} END, '.') AS v,
    CASE WHEN list_contains(cu, 'DEPENDING') THEN {_after(['TO'], [])} ELSE '' END AS o2,
    {_after(['OCCURS'], [])} AS o1,
    rtrim({_after(['DEPENDING'], ['ON'])}, '.') AS occurs_depending,
    rtrim({_after(['REDEFINES'], [])}, '.') AS redefines
  FROM item_words),
items AS (
  SELECT path, item_no, section, fd, level, name, clauses, picture,
    CASE WHEN use1 <> '' THEN use1 ELSE use2 END AS usage,
    nullif(CASE {' '.join(f"WHEN upper(v) = '{w}' THEN '{s}'" for w, s in FIGURATIVE.items())} 
      ELSE {_LITERAL_TEXT.format(v='v')} END, '') AS value,
    CAST(TRY_CAST(coalesce(nullif(o2, ''), nullif(o1, ''), '0') AS INTEGER) AS BIGINT) AS occurs,
    occurs_depending, redefines, upper(name) = 'FILLER' AS is_filler, level = 88 AS is_88
  FROM item_clauses)"""

_PARENTS = _ITEMS + """,
parents AS (
  SELECT a.path, a.item_no, max(b.item_no) AS parent_no
  FROM items a LEFT JOIN items b
    ON a.path = b.path AND a.section = b.section AND a.fd = b.fd AND b.item_no < a.item_no AND b.level < a.level
   AND b.level <> 88 AND a.level NOT IN (1, 77)
  GROUP BY a.path, a.item_no),
placed AS (
  SELECT i.*, p.parent_no, EXISTS (SELECT 1 FROM parents c WHERE c.path = i.path AND c.parent_no = i.item_no) AS has_children
  FROM items i JOIN parents p ON i.path = p.path AND i.item_no = p.item_no)"""

_TYPED = _PARENTS + """,
digits AS (
  SELECT *, has_children AND picture = '' AS is_group,
    regexp_replace(upper(picture), '^[S+-]+', '') AS dg FROM placed),
measured AS (
  SELECT *, regexp_matches(dg, '^([9Z0](\\(\\d+\\))?|[V.])+$') AND regexp_matches(dg, '[9Z0]') AND NOT is_88 AND NOT is_group AS num,
    CAST(list_sum(list_transform(regexp_extract_all(dg, '[9Z0](\\(\\d+\\))?'),
      lambda r: CASE WHEN length(r) = 1 THEN 1 ELSE CAST(regexp_extract(r, '(\\d+)\\)', 1) AS BIGINT) END)) AS BIGINT) AS p,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(dg, '[V.](.*)$', 1), '[9Z0](\\(\\d+\\))?'),
      lambda r: CASE WHEN length(r) = 1 THEN 1 ELSE CAST(regexp_extract(r, '(\\d+)\\)', 1) AS BIGINT) END)), 0) AS BIGINT) AS sc
  FROM digits),
typed AS (
  SELECT *, CASE WHEN num THEN p END AS precision, CASE WHEN num THEN sc END AS scale,
    CASE WHEN is_88 THEN 'boolean' WHEN is_group THEN 'struct'
      WHEN picture = '' THEN CASE
        WHEN usage IN ('COMP-1', 'FLOAT-SHORT') THEN 'float'
        WHEN usage IN ('COMP-2', 'FLOAT-LONG', 'FLOAT-EXTENDED') THEN 'double'
        WHEN usage IN ('BINARY-SHORT', 'NATIVE-2') THEN 'smallint'
        WHEN usage IN ('BINARY-DOUBLE', 'POINTER', 'FUNCTION-POINTER', 'PROCEDURE-POINTER', 'NATIVE-8') THEN 'bigint'
        WHEN usage = 'BINARY-CHAR' THEN 'tinyint'
        WHEN usage = 'OBJECT-REFERENCE' THEN 'unsupported'
        WHEN usage IN ('NATIONAL', 'DISPLAY-1') THEN 'string'
        WHEN usage = 'NATIVE-4' OR contains(usage, 'COMP') OR contains(usage, 'BINARY') THEN 'int'
        ELSE 'string' END
      WHEN NOT num OR p > 38 THEN 'string'
      WHEN regexp_matches(dg, '[V.]') OR contains(usage, 'COMP-3') OR contains(usage, 'PACKED') OR p > 18
        THEN concat('decimal(', p, ',', sc, ')')
      WHEN p <= 9 THEN 'int' ELSE 'bigint' END AS spark_type
  FROM measured)"""

_PASCAL = "array_to_string(list_transform(string_split(replace(lower({0}), '_', '-'), '-'), lambda w: upper(w[1]) || w[2:]), '')"

# Statements: a running count of statement starts over the lines.
_STATEMENTS = _TAGS + f""",
proc_words AS (
  SELECT path, line_no, content, regexp_split_to_array(content, ' +') AS w
  FROM tagged WHERE division = 'PROCEDURE' AND dh IS NULL AND u NOT LIKE 'COPY %'),
proc_verbs AS (
  SELECT *, CASE WHEN upper(w[1]) IN ('IF', 'ELSE') THEN list_min(list_filter(range(2, len(w) + 1),
    lambda i: upper(w[i]) IN ({_words(VERBS)}))) END AS verb_at FROM proc_words),
proc_pieces AS (
  SELECT path, 2 * line_no AS line_no, CASE WHEN verb_at IS NULL THEN content ELSE array_to_string(w[:verb_at - 1], ' ') END AS content
  FROM proc_verbs
  UNION ALL SELECT path, 2 * line_no + 1, array_to_string(w[verb_at:], ' ') FROM proc_verbs WHERE verb_at IS NOT NULL),
proc_lines AS (
  SELECT path, line_no, content, upper(content) AS u, CASE WHEN upper(content) LIKE 'EXEC %' THEN 1 ELSE 0 END AS opens,
    CASE WHEN contains(upper(content), 'END-EXEC') THEN 1 ELSE 0 END AS closes
  FROM proc_pieces),
proc_state AS (
  SELECT *, coalesce(sum(opens - closes) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside,
    lag(content) OVER (PARTITION BY path ORDER BY line_no) AS prev,
    regexp_extract(u, '^(\\S+?)(?:\\s|\\.*$)', 1) AS head
  FROM proc_lines),
proc_starts AS (
  SELECT *, CASE WHEN inside > 0 THEN 0
    WHEN prev IS NULL OR prev LIKE '%.' OR contains(upper(prev), 'END-EXEC') OR opens = 1
      OR head IN ({_words(VERBS + TERMINATORS + ['ELSE', 'WHEN', 'NOT'])})
      OR regexp_matches(u, '^[A-Z0-9][-A-Z0-9]*\\s+SECTION\\s*\\.?$')
      OR regexp_matches(u, '^[A-Z0-9][-A-Z0-9]*\\s*\\.\\s*$') THEN 1 ELSE 0 END AS starts
  FROM proc_state),
proc_groups AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line_no) AS g FROM proc_starts),
texts AS (
  SELECT path, g, string_agg(content, ' ' ORDER BY line_no) AS full_text FROM proc_groups GROUP BY path, g),
headers AS (
  SELECT *, upper(trim(rtrim(full_text, '.'))) AS h,
    full_text LIKE '%.' AS ends
  FROM texts),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(h, '^[A-Z0-9][-A-Z0-9]*\\s+SECTION$') THEN 'section'
    WHEN regexp_matches(h, '^[A-Z0-9][-A-Z0-9]*$') AND h NOT IN ({_words(VERBS + TERMINATORS + ['ELSE', 'WHEN'])}) THEN 'paragraph'
    ELSE 'statement' END AS kind
  FROM headers),
runs AS (
  SELECT *, sum(CASE WHEN kind = 'statement' THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY g) AS run,
    coalesce(last_value(CASE WHEN kind = 'section' THEN regexp_extract(h, '^(\\S+)', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY g), '') AS section
  FROM kinds),
paragraph_runs AS (
  SELECT path, run, min(section) AS section,
    coalesce(max(CASE WHEN kind = 'paragraph' THEN h END), 'MAIN') AS paragraph
  FROM runs GROUP BY path, run
  HAVING count(*) FILTER (WHERE kind <> 'section') > 0),
paragraphs AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY run) AS paragraph_no FROM paragraph_runs),
stmts AS (
  SELECT r.path, row_number() OVER (PARTITION BY r.path ORDER BY r.g) AS stmt_no, p.paragraph_no, p.section, p.paragraph,
    1 + coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY r.path, r.run ORDER BY r.g
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_no,
    trim(rtrim(full_text, '.')) AS text
  FROM runs r JOIN paragraphs p ON r.path = p.path AND r.run = p.run WHERE kind = 'statement'),
words AS (
  SELECT *, upper(regexp_extract(text, '^(\\S+)', 1)) AS w1, upper(regexp_extract(text, '^\\S+\\s+(\\S+)', 1)) AS w2 FROM stmts),
statements AS (
  SELECT *, CASE WHEN w1 IN ({_words(TERMINATORS + ['ELSE', 'WHEN'])}) THEN NULL
    WHEN w1 = 'EXEC' AND w2 IN ({_words(EXEC_KINDS)}) THEN 'EXEC ' || w2
    WHEN w1 = 'EXEC' THEN 'EXEC OTHER'
    WHEN w1 || ' ' || w2 IN ({_words(TWO_WORD_TYPES)}) THEN w1 || ' ' || w2
    WHEN w1 IN ({_words(ONE_WORD_TYPES)}) THEN w1 ELSE 'UNKNOWN' END AS stmt_type
  FROM words)"""

# Block depth: a running sum kept from falling below zero; branch: the last mark
# of the level a statement stands on.
_DEPTH = _STATEMENTS + """,
steps AS (
  SELECT *, w1 = 'READ' AND contains(upper(text), 'AT END') AND NOT contains(upper(text), 'END-READ') AS opens_read FROM statements),
stepped AS (
  SELECT *, w1 IN ('IF', 'EVALUATE') OR opens_read AS opens,
    w1 IN ('END-IF', 'END-EVALUATE') OR (w1 = 'END-READ' AND coalesce(last_value(CASE WHEN w1 = 'READ' THEN opens_read END IGNORE NULLS)
      OVER (PARTITION BY path, paragraph_no, sentence_no ORDER BY stmt_no), false)) AS closes,
    regexp_matches(upper(text), '^NOT\\s+AT\\s+END\\b') AS not_at_end
  FROM steps),
totals AS (
  SELECT *, sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER s AS total
  FROM stepped WINDOW s AS (PARTITION BY path, paragraph_no, sentence_no ORDER BY stmt_no)),
levelled AS (
  SELECT *, total - least(0, min(total) OVER (PARTITION BY path, paragraph_no, sentence_no ORDER BY stmt_no)) AS after_it FROM totals),
deep AS (
  SELECT *, CAST(CASE WHEN opens THEN after_it - 1 WHEN w1 IN ('ELSE', 'WHEN') OR not_at_end THEN greatest(after_it - 1, 0)
    ELSE after_it END AS BIGINT) AS depth,
    CASE WHEN w1 = 'ELSE' THEN 'ELSE' WHEN w1 = 'WHEN' THEN 'WHEN ' || trim(substr(text, 5)) WHEN not_at_end THEN 'NOT AT END'
      WHEN w1 = 'IF' THEN 'THEN' WHEN opens_read THEN 'AT END' WHEN opens THEN '' END AS mark
  FROM levelled),
marks AS (SELECT path, paragraph_no, sentence_no, stmt_no, depth + 1 AS level, mark FROM deep WHERE mark IS NOT NULL),
branched AS (
  SELECT d.path, d.stmt_no, d.text, d.depth, CASE WHEN d.depth = 0 THEN '' ELSE max_by(m.mark, m.stmt_no) END AS branch
  FROM deep d LEFT JOIN marks m ON d.path = m.path AND d.paragraph_no = m.paragraph_no AND d.sentence_no = m.sentence_no
   AND m.level = d.depth AND m.stmt_no < d.stmt_no
  GROUP BY d.path, d.stmt_no, d.text, d.depth)"""


def _both(statement_ctes: str) -> str:
    """Statement and item tables in one WITH list."""
    return statement_ctes + _PARENTS[len(_TAGS):]


_EXEC = _both(_STATEMENTS) + f""",
exec_text AS (
  SELECT path, 0 AS part, line_no AS n, 'DATA' AS division, sentence AS t FROM data_sentences
    WHERE upper(sentence) LIKE 'EXEC SQL%'
  UNION ALL SELECT path, 1, stmt_no, 'PROCEDURE', text FROM statements WHERE w1 = 'EXEC'),
exec_parts AS (
  SELECT path, division, row_number() OVER (PARTITION BY path ORDER BY part, n) AS block_no,
    upper(regexp_extract(t, '(?i)^EXEC\\s+(\\w+)\\s+(.*?)\\s*END-EXEC', 1)) AS exec_type,
    trim(regexp_extract(t, '(?i)^EXEC\\s+(\\w+)\\s+(.*?)\\s*END-EXEC', 2)) AS body
  FROM exec_text),
exec_blocks AS (
  SELECT path, division, block_no, exec_type,
    CASE WHEN exec_type IN ({_words(EXEC_KINDS)}) THEN upper(regexp_extract(body, '^(\\S+)', 1)) ELSE regexp_extract(body, '^(\\S+)', 1) END AS command,
    body
  FROM exec_parts)"""


def _case(column: str, classes: dict, default: str) -> str:
    whens = " ".join(f"WHEN {column} IN ({_words(ws)}) THEN '{name}'" for name, ws in classes.items())
    return f"CASE {whens} ELSE '{default}' END"


_PARAMS = """array_to_string(list_sort(list_transform(map_entries(map_from_entries(list_transform(
      list_filter(list_transform(regexp_extract_all(body, '\\w+\\s*\\([^)]*\\)'),
        lambda p, i: {'k': upper(regexp_extract(p, '^(\\w+)', 1)), 'v': trim(regexp_extract(p, '\\(([^)]*)\\)', 1)), 'i': i}),
        lambda e: len(list_filter(list_transform(regexp_extract_all(body, '\\w+\\s*\\([^)]*\\)'),
          lambda p, i: {'k': upper(regexp_extract(p, '^(\\w+)', 1)), 'i': i}), lambda o: o.k = e.k AND o.i > e.i)) = 0),
      lambda e: {'k': e.k, 'v': e.v}))), lambda e: e.key || '=' || e.value)), ';')"""

_SELECT_PARTS = f"""select_words AS (
  SELECT *, list_transform(cw, lambda x: upper(x)) AS cu
  FROM (SELECT *, regexp_extract_all(t, '"[^"]*"|[^ ]+') AS cw FROM selects)),
select_parts AS (
  SELECT path, g, rtrim({_after(['SELECT'], [])}, '.') AS select_name,
    split_part(trim(rtrim({_after(['ASSIGN'], ['TO'])}, '.'), '"'), '.', 1) AS assign_to,
    CASE rtrim({_after(['ORGANIZATION'], ['IS'], 'cu')}, '.') WHEN '' THEN 'SEQUENTIAL' WHEN 'LINE' THEN 'LINE SEQUENTIAL'
      ELSE rtrim({_after(['ORGANIZATION'], ['IS'])}, '.') END AS organization,
    coalesce(nullif(rtrim({_after(['ACCESS'], ['MODE'], skip_is=True)}, '.'), ''), 'SEQUENTIAL') AS access_mode,
    rtrim({_after(['STATUS'], ['IS'])}, '.') AS file_status
  FROM select_words),"""

_FILES = _DATA + """,
env AS (
  SELECT *, lag(content) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM tagged WHERE division = 'ENVIRONMENT' AND dh IS NULL),
env_groups AS (
  SELECT *, sum(CASE WHEN prev LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS g FROM env),
env_selects AS (
  SELECT *, max(CASE WHEN u LIKE 'SELECT%' THEN 1 ELSE 0 END) OVER (PARTITION BY path, g ORDER BY line_no) AS in_select FROM env_groups),
selects AS (
  SELECT path, g, string_agg(content, ' ' ORDER BY line_no) || ' ' AS t FROM env_selects WHERE in_select = 1 GROUP BY path, g),
""" + _SELECT_PARTS + """
fds AS (SELECT path, fd, min(line_no) AS n FROM data_lines WHERE section = 'FILE' AND fd IS NOT NULL GROUP BY path, fd),
files AS (
  SELECT coalesce(s.path, f.path) AS path,
    row_number() OVER (PARTITION BY coalesce(s.path, f.path) ORDER BY s.g IS NULL, s.g, f.n) AS file_no,
    coalesce(select_name, fd) AS select_name, coalesce(assign_to, '') AS assign_to,
    coalesce(organization, 'SEQUENTIAL') AS organization, coalesce(access_mode, 'SEQUENTIAL') AS access_mode,
    coalesce(file_status, '') AS file_status, coalesce(fd, '') AS fd_name
  FROM select_parts s FULL OUTER JOIN fds f ON s.path = f.path AND upper(s.select_name) = f.fd)"""

_ENUMS = """,
held AS (
  SELECT a.path, a.parent_no AS item_no, p.name, a.name AS member FROM placed a JOIN placed p ON a.path = p.path AND a.parent_no = p.item_no
  WHERE a.is_88 AND a.section IN ('WORKING-STORAGE', 'LOCAL-STORAGE')),
enums AS (SELECT path, item_no, name, count(*) AS members FROM held GROUP BY path, item_no, name HAVING count(*) >= 2)"""

_RECORDS = """,
record_fields AS (
  SELECT a.path, a.parent_no AS record_no, a.section, r.name AS record, a.item_no AS field_no, a.name AS field,
    a.{type} AS spark_type, a.occurs, a.occurs_depending
  FROM {items} a JOIN {items} r ON a.path = r.path AND a.parent_no = r.item_no
  WHERE r.level = 1 AND r.picture = '' AND NOT r.is_filler AND NOT a.is_88 AND NOT a.is_filler
    AND a.section IN ('WORKING-STORAGE', 'LOCAL-STORAGE', 'LINKAGE'))"""

_SERVICES = """,
services AS (
  SELECT path, split_part(paragraph, '-', 1) AS prefix, count(*) AS paragraphs FROM paragraphs
  WHERE contains(paragraph, '-') GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _hit(hint: str) -> str:
    text = (hint[3:] if hint.startswith("re:") else hint).replace("'", "''")
    return f"regexp_matches(u, '{text}')" if hint.startswith("re:") else f"contains(u, '{text}')"


def _score(dialect: str) -> str:
    terms = [
        f"CASE WHEN {' AND '.join('(' + ' OR '.join(map(_hit, g)) + ')' for g in groups)} THEN {weights[dialect]} ELSE 0 END"
        for groups, weights in DIALECT_RULES
        if dialect in weights
    ]
    return " + ".join(terms) or "0"


_SCORES = f"sources AS ({estate_sql()}), up AS (SELECT path, upper(text) AS u FROM sources), vendor_scores AS (" + " UNION ALL ".join(
    f"SELECT path, '{d}' AS vendor, {n} AS rank, CAST({_score(d)} AS BIGINT) AS score FROM up" for n, d in enumerate(DIALECTS)
) + ")"


def _any(words) -> str:
    return " OR ".join(f"contains(upper(text), '{w}')" for w in words)


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_PROGRAMS = """SELECT path, max(CASE WHEN k = 'P' THEN rtrim(regexp_extract(content, '(?i)PROGRAM-ID\\.\\s*(\\S+)', 1), '.') END) AS pid,
    max(CASE WHEN k = 'C' THEN rtrim(regexp_extract(content, '(?i)CLASS-ID\\.\\s*(\\S+)', 1), '.') END) AS class_id,
    max(CASE WHEN k = 'A' THEN rtrim(regexp_extract(content, '(?i)AUTHOR\\.\\s*(.*)', 1), '.') END) AS author,
    max(CASE WHEN k = 'D' THEN rtrim(regexp_extract(content, '(?i)DATE-WRITTEN\\.\\s*(.*)', 1), '.') END) AS date_written
  FROM (SELECT *, CASE WHEN division <> 'IDENTIFICATION' OR dh IS NOT NULL THEN '' WHEN contains(u, 'PROGRAM-ID') THEN 'P'
    WHEN contains(u, 'CLASS-ID') THEN 'C' WHEN contains(u, 'AUTHOR') THEN 'A' WHEN contains(u, 'DATE-WRITTEN') THEN 'D' ELSE '' END AS k FROM tagged)
  GROUP BY path"""

_ALL = _both(_STATEMENTS) + _FILES[len(_DATA):]

ORACLES = {
    "e1_read_sources": _q(f"sources AS ({estate_sql()})", "SELECT 'program=' || replace(path, '/', '%2F') AS rel_dir, text || chr(10) AS text FROM sources"),
    "e2_rel_dir": _q(f"sources AS ({estate_sql()})", "SELECT split_part(path, '/', 2) AS rel_dir, count(*) AS files FROM sources GROUP BY 1"),
    "e3_write_estate": _q(_FILES, """SELECT split_part(path, '/', 2) AS rel_dir, path, count(*) AS n, 'files' AS name FROM files GROUP BY path
UNION ALL SELECT split_part(path, '/', 2), path, count(*), 'copies' FROM (SELECT path, rtrim(regexp_extract(u, 'COPY\\s+(\\S+)', 1), '.') AS member, 'ENVIRONMENT' AS division
FROM env_selects WHERE in_select = 0 AND regexp_matches(u, 'COPY\\s+\\S')
UNION ALL SELECT path, rtrim(regexp_extract(upper(sentence), '^COPY\\s+(\\S+)', 1), '.'), 'DATA' FROM data_sentences
WHERE regexp_matches(upper(sentence), '^COPY\\s+\\S')) GROUP BY path"""),
    "e4_physical_lines": _q(_LINES, "SELECT path, line_no, raw FROM raw"),
    "e5_clean_fixed": _q(_LINES, "SELECT path, line_no, kind, content FROM kept"),
    "e6_clean_free": _q(_LINES, "SELECT path, row_number() OVER (PARTITION BY path ORDER BY n) AS line_no, content FROM free"),
    "e7_merge_continuations": _q(_LINES, "SELECT path, line_no, content FROM lines"),
    "e8_tag_long_files": _q(_TAGS, "SELECT path, line_no, division, data_section, content FROM tagged"),
    "e8_tag_structure": _q(_TAGS, "SELECT path, line_no, division, data_section, content FROM tagged"),
    "e9_data_items": _q(_ITEMS, """SELECT path, item_no, section, fd, level, name, picture, usage, value, occurs, occurs_depending,
redefines, is_filler, is_88 FROM items"""),
    "e10_conditions": _q(_PARENTS, """SELECT path, parent_no, item_no, name,
array_to_string(list_transform(regexp_extract_all(regexp_extract(clauses, '(?i)VALUES?\\s+(?:ARE\\s+|IS\\s+)?(.*)', 1),
  '(?i)(?:"[^"]*"|''[^'']*''|[^\\s,]+)(?:\\s+THR(?:U|OUGH)\\s+(?:"[^"]*"|''[^'']*''|[^\\s,]+))?'),
  lambda v: regexp_replace(v, '["'']', '', 'g')), '|') AS condition_values
FROM placed WHERE is_88"""),
    "e11_item_hierarchy": _q("RECURSIVE " + _PARENTS + """,
depths AS (SELECT path, item_no, 0 AS depth FROM placed WHERE parent_no IS NULL
  UNION ALL SELECT p.path, p.item_no, d.depth + 1 FROM placed p JOIN depths d ON p.path = d.path AND p.parent_no = d.item_no)""",
        """SELECT p.path, p.item_no, level, name, parent_no, CAST(depth AS BIGINT) AS depth
FROM placed p JOIN depths d ON p.path = d.path AND p.item_no = d.item_no"""),
    "e12_item_types": _q(_TYPED, "SELECT path, item_no, name, spark_type, precision, scale FROM typed"),
    "e13_names": _q(_ITEMS, f"""SELECT path, item_no, lower(c[1]) || c[2:] AS field_name, c AS class_name
FROM (SELECT path, item_no, {_PASCAL.format('name')} AS c FROM items)"""),
    "e14_program_header": _q(_TAGS, f"""SELECT path, coalesce(pid, class_id) AS program_id, class_id, author, date_written,
class_id IS NOT NULL AS is_class FROM ({_PROGRAMS})"""),
    "e15_file_control": _q(_FILES, "SELECT * FROM files"),
    "e16_statements": _q(_STATEMENTS, "SELECT path, stmt_no, paragraph_no, section, paragraph, CAST(sentence_no AS BIGINT) AS sentence_no, text FROM stmts"),
    "e17_verb_types": _q(_STATEMENTS, "SELECT path, stmt_no, stmt_type FROM statements WHERE stmt_type IS NOT NULL"),
    "e18_block_depth": _q(_DEPTH, "SELECT path, stmt_no, text, depth, coalesce(branch, '') AS branch FROM branched"),
    "e19_exec_blocks": _q(_EXEC, "SELECT * FROM exec_blocks"),
    "e20_sql_blocks": _q(_EXEC, f"""SELECT path, division, block_no, command, {_case('command', SQL_CLASSES, 'OTHER')} AS sql_class,
array_to_string(regexp_extract_all(regexp_replace(body, '''[^'']*''|"[^"]*"', ' ', 'g'), ':([A-Za-z0-9-]+)', 1), ',') AS host_vars,
CASE WHEN command = 'INCLUDE' THEN regexp_extract(body, '^\\S+\\s+(\\S+)', 1) ELSE '' END AS copybook
FROM exec_blocks WHERE exec_type = 'SQL'"""),
    "e21_cics_blocks": _q(_EXEC, f"""SELECT path, block_no, command,
CASE WHEN command = 'HANDLE' THEN CASE upper(regexp_extract(body, '^\\S+\\s+(\\S+)', 1)) WHEN 'CONDITION' THEN 'HANDLE_CONDITION'
  WHEN 'AID' THEN 'HANDLE_AID' WHEN 'ABEND' THEN 'HANDLE_ABEND' ELSE 'ERROR_HANDLING' END
  ELSE {_case('command', CICS_CLASSES, 'OTHER')} END AS cics_class,
{_PARAMS} AS params FROM exec_blocks WHERE exec_type = 'CICS'"""),
    "e22_dli_blocks": _q(_EXEC, f"""SELECT path, block_no, command, 'IMS' AS dli_class, {_PARAMS} AS params
FROM exec_blocks WHERE exec_type = 'DLI'"""),
    "e23_copies": _q(_FILES, """SELECT path, rtrim(regexp_extract(u, 'COPY\\s+(\\S+)', 1), '.') AS member, 'ENVIRONMENT' AS division
FROM env_selects WHERE in_select = 0 AND regexp_matches(u, 'COPY\\s+\\S')
UNION ALL SELECT path, rtrim(regexp_extract(upper(sentence), '^COPY\\s+(\\S+)', 1), '.'), 'DATA' FROM data_sentences
WHERE regexp_matches(upper(sentence), '^COPY\\s+\\S')"""),
    "e24_calls": _q(_STATEMENTS, """SELECT path, stmt_no, regexp_extract(text, '(?i)CALL\\s+["''](\\S+)["'']', 1) AS callee,
array_to_string(list_filter(regexp_split_to_array(trim(regexp_extract(text, '(?i)CALL\\s+["''](\\S+)["'']\\s*USING\\s+(.*)', 2)), '\\s+'),
  lambda a: a <> '' AND upper(a) NOT IN ('BY', 'REFERENCE', 'CONTENT', 'VALUE')), ',') AS args
FROM statements WHERE stmt_type = 'CALL' AND regexp_matches(text, '(?i)CALL\\s+["''](\\S+)["'']')"""),
    "e25_screen_fields": _q(_ITEMS + """,
screen AS (
  SELECT *, list_transform(cw, lambda x: upper(x)) AS cu
  FROM (SELECT *, regexp_extract_all(clauses, '"[^"]*"|[^ ]+') AS cw FROM items WHERE section = 'SCREEN'))""", f"""SELECT path, item_no, level, name,
CAST(coalesce(nullif({_after(['LINE'], ['NUMBER'], skip_is=True)}, ''), '0') AS BIGINT) AS line,
CAST(coalesce(nullif({_after(['COL', 'COLUMN'], ['NUMBER'], skip_is=True)}, ''), '0') AS BIGINT) AS col,
rtrim({_after(['PIC', 'PICTURE'], ['IS'])}, '.') AS pic,
trim(rtrim({_after(['VALUE'], ['IS'])}, '.'), '"') AS value,
rtrim({_after(['FROM'], [])}, '.') AS from_field,
rtrim({_after(['TO'], [])}, '.') AS to_field,
coalesce(list_filter(['HIGHLIGHT', 'REVERSE-VIDEO', 'UNDERLINE', 'BLINK', 'BLANK WHEN ZERO'], lambda a: contains(array_to_string(cu, ' '), a))[1], '') AS attribute
FROM screen"""),
    "e26_goto_targets": _q(_STATEMENTS, """SELECT path, stmt_no, paragraph AS source, trim(regexp_extract(text, '(?i)GO\\s+TO\\s+(.*)', 1)) AS target
FROM statements WHERE stmt_type = 'GO TO'"""),
    "e26_perform_targets": _q(_STATEMENTS, """SELECT path, stmt_no, paragraph AS source,
CASE WHEN inl THEN 'INLINE' WHEN contains(upper(text), ' VARYING ') THEN 'VARYING'
  WHEN regexp_matches(text, '(?i)^PERFORM\\s+\\S+\\s+UNTIL\\s') THEN 'UNTIL'
  WHEN regexp_matches(text, '(?i)^PERFORM\\s+\\S+\\s+\\S+\\s+TIMES') THEN 'TIMES'
  WHEN contains(upper(text), ' THRU ') THEN 'THRU' ELSE 'PLAIN' END AS form,
CASE WHEN inl THEN '' ELSE regexp_extract(text, '^\\S+\\s+(\\S+)', 1) END AS target,
CASE WHEN inl THEN '' ELSE regexp_extract(text, '(?i)^PERFORM\\s+\\S+\\s+THRU\\s+(\\S+)', 1) END AS thru_target
FROM (SELECT *, w2 IN ('UNTIL', 'VARYING', 'WITH', 'TEST', '') OR regexp_matches(text, '(?i)^PERFORM\\s+\\S+\\s+TIMES\\b') AS inl FROM statements)
WHERE stmt_type = 'PERFORM'"""),
    "e27_dialect_flags": _q(_STATEMENTS, f"""SELECT path, stmt_no, dialect, flag FROM (
SELECT path, stmt_no, 'unisys' AS dialect, CASE WHEN upper(text) LIKE 'GIVE%' THEN 'GIVE' WHEN upper(text) LIKE 'RECEIVE%' THEN 'RECEIVE'
  WHEN upper(text) LIKE 'PORT%' THEN 'PORT' WHEN upper(text) LIKE 'CHANGE%' AND contains(upper(text), 'ATTRIBUTE') THEN 'CHANGE_ATTRIBUTE'
  WHEN contains(upper(text), 'DMSII') THEN 'DMSII' END AS flag FROM statements
UNION ALL SELECT path, stmt_no, 'fujitsu', CASE WHEN contains(upper(text), 'FORMAT') AND ({_any(['PRINTING MODE', 'FREE', 'FIXED'])}) THEN 'FORMAT' END FROM statements
UNION ALL SELECT path, stmt_no, 'nec', CASE WHEN {_any(NEC_WORDS)} THEN 'ACOS' END FROM statements
UNION ALL SELECT path, stmt_no, 'bull', CASE WHEN {_any(BULL_WORDS)} THEN 'GCOS' END FROM statements) WHERE flag IS NOT NULL"""),
    "e28_vendor_scores": _q(_SCORES, "SELECT path, vendor, score FROM vendor_scores"),
    "e28_detect_dialect": _q(_SCORES, """SELECT path, CASE WHEN max(score) = 0 THEN 'standard' ELSE arg_max(vendor, score * 100 - rank) END AS dialect,
max(score) AS score FROM vendor_scores GROUP BY path"""),
    "e29_program_summary": _q(_ALL, """SELECT s.path, coalesce(l.n, 0) AS lines, coalesce(i.n, 0) AS items, coalesce(i.roots, 0) AS working_roots,
coalesce(i.screen, 0) AS screen_items, coalesce(p.outside, 0) AS paragraphs, coalesce(p.inside, 0) AS section_paragraphs,
coalesce(x.n, 0) AS sections, coalesce(f.n, 0) AS files,
coalesce(t.q, false) OR coalesce(dq.q, false) AS has_sql, coalesce(t.c, false) AS has_cics, coalesce(t.d, false) AS has_dli,
contains(s.text, chr(10) || '       CLASS-ID. ') AS has_class
FROM sources s
LEFT JOIN (SELECT path, count(*) AS n FROM lines GROUP BY path) l ON s.path = l.path
LEFT JOIN (SELECT path, count(*) AS n, count(*) FILTER (WHERE section = 'WORKING-STORAGE' AND level IN (1, 77)) AS roots,
  count(*) FILTER (WHERE section = 'SCREEN') AS screen FROM items GROUP BY path) i ON s.path = i.path
LEFT JOIN (SELECT path, count(*) FILTER (WHERE section = '') AS outside, count(*) FILTER (WHERE section <> '') AS inside FROM paragraphs GROUP BY path) p ON s.path = p.path
LEFT JOIN (SELECT path, count(*) AS n FROM kinds WHERE kind = 'section' GROUP BY path) x ON s.path = x.path
LEFT JOIN (SELECT path, count(*) AS n FROM files GROUP BY path) f ON s.path = f.path
LEFT JOIN (SELECT path, bool_or(stmt_type = 'EXEC SQL') AS q, bool_or(stmt_type = 'EXEC CICS') AS c, bool_or(stmt_type = 'EXEC DLI') AS d
  FROM statements GROUP BY path) t ON s.path = t.path
LEFT JOIN (SELECT path, bool_or(upper(sentence) LIKE 'EXEC SQL%') AS q FROM data_sentences GROUP BY path) dq ON s.path = dq.path"""),
    "e30_class_summary": _q(_ALL + _ENUMS + _RECORDS.format(type="picture", items="placed") + _SERVICES, """SELECT path, data_classes, enums, services, file_handlers,
1 + data_classes + enums + services + file_handlers AS total FROM (
SELECT s.path, (SELECT count(DISTINCT record_no) FROM record_fields r WHERE r.path = s.path) AS data_classes,
(SELECT count(*) FROM enums e WHERE e.path = s.path) AS enums,
(SELECT count(*) FROM services v WHERE v.path = s.path) AS services,
(SELECT count(*) FROM files f WHERE f.path = s.path) AS file_handlers FROM sources s)"""),
    "e31_run_outcome": _q(_TAGS, f"""SELECT CASE WHEN coalesce(pid, class_id) IS NULL THEN 'error' ELSE 'success' END AS outcome, count(*) AS programs
FROM ({_PROGRAMS}) GROUP BY 1"""),
    "e32_record_schemas": _q(_PARENTS + _RECORDS.format(type="picture", items="placed"), f"""SELECT path, record_no, section, record, count(*) AS fields,
{_PASCAL.format('record')} AS class_name FROM record_fields GROUP BY path, record_no, section, record"""),
    "e32_record_fields": _q(_TYPED + _RECORDS.format(type="spark_type", items="typed"), "SELECT * FROM record_fields"),
    "e33_enum_candidates": _q(_PARENTS + _ENUMS, f"SELECT path, item_no, name, members, {_PASCAL.format('name')} || 'Type' AS enum_name FROM enums"),
    "e33_enum_members": _q(_PARENTS + _ENUMS, """SELECT h.path, h.item_no, h.name, replace(upper(h.member), '-', '_') AS member
FROM held h JOIN enums e ON h.path = e.path AND h.item_no = e.item_no"""),
    "e34_service_groups": _q(_STATEMENTS + _SERVICES, f"SELECT path, prefix, {_PASCAL.format('prefix')} || 'Service' AS class_name, paragraphs FROM services"),
    "e34_service_members": _q(_STATEMENTS + _SERVICES, """SELECT p.path, s.prefix, p.paragraph_no, p.paragraph FROM paragraphs p JOIN services s
ON p.path = s.path AND split_part(p.paragraph, '-', 1) = s.prefix WHERE contains(p.paragraph, '-')"""),
    "e35_file_handlers": _q(_FILES, f"SELECT path, file_no, select_name, {_PASCAL.format('select_name')} || 'Handler' AS class_name, organization FROM files"),
    "e36_readiness": _q(_STATEMENTS, f"""SELECT path, stmt_type, count(*) AS statements FROM statements
WHERE stmt_type IN ({_words(UNCONVERTED_TYPES)}) OR (stmt_type = 'EXEC CICS' AND
upper(regexp_extract(text, '^\\S+\\s+\\S+\\s+(\\S+)', 1)) NOT IN ({_words([c for ws in CICS_CLASSES.values() for c in ws] + ['HANDLE'])}))
GROUP BY path, stmt_type"""),
    "e37_verb_counts": _q(_STATEMENTS, "SELECT path, stmt_type, count(*) AS statements FROM statements WHERE stmt_type IS NOT NULL GROUP BY path, stmt_type"),
    "e37_verb_profile": _q(_STATEMENTS, "SELECT path, " + ", ".join(
        f"count(*) FILTER (WHERE stmt_type = '{t}') AS \"{t.lower().replace(' ', '_').replace('-', '_')}\"" for t in STATEMENT_TYPES
    ) + " FROM statements GROUP BY path"),
    "e38_entry_paragraph": _q(_STATEMENTS, """SELECT path, arg_min(paragraph, paragraph_no + CASE WHEN section = '' THEN 0 ELSE 1000000 END) AS paragraph
FROM paragraphs GROUP BY path"""),
    "e39_diff_items": _q(_ITEMS + """,
theirs AS (SELECT i.* FROM items i JOIN (SELECT DISTINCT path FROM tagged WHERE content = 'AUTHOR. TEAM-4.') t ON i.path = t.path)""",
        """SELECT path, 'changed' AS change, name, item_no AS place_a, 'usage' AS field, usage AS value_a, 'COMP' AS value_b
FROM theirs WHERE regexp_matches(clauses, 'V99 COMP-3')
UNION ALL SELECT path, 'removed', name, item_no, NULL, NULL, NULL FROM theirs WHERE name IN ('AUDIT-REC', 'WS-TITLE')
UNION ALL SELECT path, 'added', 'WS-HEADING', NULL, NULL, NULL, NULL FROM theirs WHERE name = 'WS-TITLE'
UNION ALL SELECT path, 'moved', name, item_no, NULL, NULL, NULL FROM theirs WHERE name = 'PR-KEY'"""),
    "e39_diff_estates": _q(_ITEMS, """SELECT path, item_no, name, picture, CASE side WHEN 'a' THEN usage ELSE 'COMP' END AS usage, side
FROM items, (VALUES ('a'), ('b')) AS v(side) WHERE regexp_matches(clauses, 'V99 COMP-3')"""),
}
