"""DuckDB twins of the model bindings (see ``plans.bindings``)."""

NOW_SQL = "TIMESTAMP '2001-08-01 00:00:00'"

CTE = {
    "posting": """
SELECT o.o_orderkey AS id,
       'REF-' || CAST(o.o_orderkey AS VARCHAR) AS reference_id,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'H-' || CAST(o.o_orderkey AS VARCHAR) END AS hash_id,
       c.c_mktsegment || ' Engineer' AS title,
       c.c_name AS company,
       c.c_mktsegment || ' Engineer' || ' at ' || c.c_name || ' since ' || strftime(o.o_orderdate, '%Y-%m-%d') AS description,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'APPLIED' WHEN '2' THEN 'APPROVED'
            WHEN '3' THEN 'SCORED' WHEN '4' THEN 'FETCHED' WHEN '5' THEN 'REJECTED' END AS status,
       CASE o.o_orderstatus WHEN 'O' THEN 'IDLE' WHEN 'P' THEN 'QUEUED' WHEN 'F' THEN 'PROCESSING' END AS processing_status,
       CASE WHEN substr(o.o_orderpriority, 1, 1) = '4' THEN NULL
            ELSE CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 101 AS INTEGER) END AS match_score,
       CAST(NULL AS VARCHAR) AS employer_email,
       CAST(NULL AS VARCHAR) AS notes,
       CAST(NULL AS VARCHAR) AS ai_analysis,
       CAST(NULL AS VARCHAR) AS portal_url,
       CASE WHEN substr(o.o_orderpriority, 1, 1) = '4' THEN NULL
            ELSE CAST(o.o_orderdate AS TIMESTAMP)
                 + to_microseconds(CAST(o.o_orderkey % 4 * 20000000 + o.o_orderkey % 5 * 1500 AS BIGINT)) END AS scored_at,
       o.o_orderdate AS created_at
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
    "application": """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
         || '-' || CAST(l_suppkey AS VARCHAR) AS id,
       l_orderkey AS job_id,
       'cv_' || CAST(l_partkey AS VARCHAR) || '.pdf' AS cv_path,
       'cl_' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS letter_path,
       l_shipdate AS created_at,
       l_linenumber, l_partkey, l_suppkey
FROM lineitem""",
    "message": """
SELECT e.event_id AS message_id,
       'inbox' AS mailbox,
       CASE WHEN e.event_type = 'signup' THEN 'noreply@unknown.example'
            ELSE lower(c.c_name) || '@mail.example' END AS from_addr,
       CASE e.event_type WHEN 'error' THEN 'Status update' WHEN 'purchase' THEN 'Application status'
            WHEN 'view' THEN 'Update' WHEN 'click' THEN 'Newsletter' WHEN 'signup' THEN 'Status update'
            ELSE '' END AS subject,
       CASE e.event_type WHEN 'error' THEN 'Unfortunately we went with other candidates.'
            WHEN 'purchase' THEN 'We would like to invite you to an interview.'
            WHEN 'view' THEN 'Thank you for your message.'
            WHEN 'click' THEN 'Our latest news.'
            WHEN 'signup' THEN 'Unfortunately the position is closed.'
            ELSE '' END AS body,
       e.ts AS received_at
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "action": """
SELECT event_id AS seq, ts, user_id AS job_id,
       CASE WHEN event_type = 'signup' THEN (CASE WHEN value >= 200.0 THEN 'reject' ELSE 'analyze' END)
            WHEN event_type = 'click' THEN 'approve'
            WHEN event_type = 'view' THEN 'notes'
            WHEN event_type = 'error' THEN 'ignore'
            WHEN event_type = 'purchase' THEN 'dispatched' END AS action,
       CASE WHEN event_type = 'view' THEN props END AS arg
FROM events""",
    "call": """
SELECT user_id AS service, ts, event_id AS call_id, event_type = 'error' AS failed, value AS duration_s
FROM events""",
    "raw_source": """
SELECT source AS reference_id, CAST(1 AS BIGINT) AS page, doc_id AS pos, doc_id FROM documents""",
    "raw_text": """
SELECT sha256(text) AS reference_id, CAST(1 AS BIGINT) AS page, doc_id AS pos, doc_id FROM documents""",
    "stored_text": """
SELECT sha256(d.text) AS reference_id FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM labels)""",
    "reply": r"""
SELECT doc_id AS job_id,
       CASE doc_id % 6
         WHEN 0 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '{"score": ' || CAST(n_chars % 101 AS VARCHAR)
                     || ', "letter": ' || '"' || replace(replace(text, '"', '\"'), chr(10), '\n') || '"'
                     || ', "analysis": ["• a", "• b", "• c"]}' || chr(10) || '```'
         WHEN 1 THEN '```' || chr(10) || '{"match_score": ' || CAST(n_chars % 101 AS VARCHAR)
                     || ', "coverLetter": ' || '"' || replace(replace(text, '"', '\"'), chr(10), '\n') || '"'
                     || '}' || chr(10) || '```'
         WHEN 2 THEN '{"rating": "' || CAST(n_chars % 101 AS VARCHAR) || CASE WHEN n_chars % 2 = 0 THEN '.5' ELSE '' END
                     || '", "reasoning": ' || '"' || replace(replace(text, '"', '\"'), chr(10), '\n') || '"' || '}'
         WHEN 3 THEN 'Sure. {"matchScore": ' || CAST(n_chars % 101 AS VARCHAR) || '.9, "explanation": ["x", '
                     || '"' || replace(replace(text, '"', '\"'), chr(10), '\n') || '"' || ']} Thanks!'
         WHEN 4 THEN text
         ELSE '  ' || chr(10) || ' ' || CASE WHEN n_chars % 2 = 0 THEN '' ELSE text END
       END AS raw
FROM documents""",
    "memory": """
SELECT vec_id AS mem_id, 'vec ' || CAST(vec_id AS VARCHAR) AS content,
       label, CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings""",
    "feed": """
SELECT CASE WHEN lang IN ('en', 'fr') THEN 'R-' || CAST(doc_id AS VARCHAR) END AS refnr,
       CASE WHEN lang IN ('en', 'de') THEN 'H-' || CAST(doc_id AS VARCHAR) END AS hashId,
       CASE WHEN lang <> 'es' THEN source END AS titel,
       CASE WHEN lang <> 'de' THEN 'Employer ' || source END AS arbeitgeber,
       CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'es' THEN '' ELSE upper(lang) END AS ort,
       CAST(1 AS BIGINT) AS page, doc_id AS pos
FROM documents""",
    "detail": """
SELECT 'H-' || CAST(d.doc_id AS VARCHAR) AS detail_key,
       'R-' || CAST(d.doc_id AS VARCHAR) AS refnr,
       CASE WHEN l.quality = 1 THEN d.text WHEN l.toxic = 1 THEN ' ' ELSE '' END AS stellenbeschreibung,
       CASE WHEN l.toxic = 1 THEN NULL ELSE 'Develop ' || d.source END AS taetigkeit,
       CASE WHEN l.quality = 0 THEN '  ' ELSE 'Experience with ' || d.lang END AS anforderungen,
       CASE WHEN l.toxic = 1 THEN 'https://jobs.example/' || CAST(d.doc_id AS VARCHAR) ELSE ' ' END AS externeUrl,
       CASE WHEN l.quality = 1 THEN 'jobs' || CAST(d.doc_id AS VARCHAR) || '@x.example'
            WHEN l.toxic = 1 THEN ' ' END AS k_email,
       CASE WHEN l.toxic = 0 THEN 'hr' || CAST(d.doc_id AS VARCHAR) || '@y.example' ELSE '' END AS a_email
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "doc_posting": """
SELECT doc_id, 'DOC-' || CAST(doc_id AS VARCHAR) AS reference_id, text AS title,
       CASE WHEN lang = 'es' THEN NULL ELSE source END AS company, text AS description,
       CASE WHEN lang = 'de' THEN 'ARCHIVED' ELSE 'FETCHED' END AS status,
       'IDLE' AS processing_status, CAST(NULL AS VARCHAR) AS employer_email, CAST(NULL AS VARCHAR) AS portal_url
FROM documents""",
}
