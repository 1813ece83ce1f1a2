"""The catalog's queries in DuckDB SQL, written from the definitions of the operators."""

from __future__ import annotations

WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
K = 5


def _norm(text: str) -> str:
    squeezed = f"regexp_replace(lower({text}), '[{WS}]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({squeezed}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _sub(position: str) -> str:
    return f"[5,4,3,2,1][least({position}, 5)]"


def _indel(position: str) -> str:
    return f"[10,8,6,4,2][least({position}, 5)]"


def _lines(texts: str) -> str:
    """Lines of a relation (source_text, text)."""
    return f"""
    select original_sentence, {_norm("original_sentence")} as normalized_sentence,
           source_text, "offset"
    from (select source_text, unnest(parts) as original_sentence,
                 unnest(range(1, len(parts) + 1))::int as "offset"
          from (select source_text, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as parts
                from ({texts})))
    where {_norm("original_sentence")} <> ''"""


# Relations other statements build on, in order of dependence.
RELATIONS = {
    "lines": _lines("select source || '/' || doc_id || '.txt' as source_text, text from documents"),
    "numbered": """
    select *, row_number() over (order by normalized_sentence, source_text, "offset") - 1 as line_id
    from lines""",
    "queries": f"""
    select query_id, intended,
           case kind when 0 then intended
                when 1 then before || 'q' || substring(intended, place + 1)
                when 2 then before || 'q' || substring(intended, place)
                else before || substring(intended, place + 1) end as query_text
    from (select *, substring(intended, 1, place - 1) as before
          from (select item_id * 1000 + part as query_id, (item_id + part) % 4 as kind, intended,
                       ((item_id + part) % length(intended))::int + 1 as place
                from (select item_id, unnest(parts) as intended,
                             unnest(range(0, len(parts))) as part
                      from (select item_id, regexp_extract_all({_norm("text")}, '.{{1,24}}') as parts
                            from benchmark))))""",
    "admitted": f"""
    select * from (select *, {_norm("query_text")} as query from queries) where query <> ''""",
    "distinct_queries": "select distinct query, length(query)::int as l from admitted",
    "chunks": """
    select conv_id as session_id, turn as seq,
           case when (conv_id + turn) % 5 = 3 then left(text, 10) || '#' || substring(text, 11)
                when (conv_id + turn) % 7 = 4 then ''
                when (conv_id + turn) % 11 = 5 then '   '
                else text end as chunk
    from conversations""",
    "typed_chunks": """
    select item_id as session_id, seq,
           case when seq % 6 = 5 then '#' || stretch when seq % 9 = 4 then '' else stretch end as chunk
    from (select item_id, unnest(parts) as stretch, unnest(range(0, len(parts))) as seq
          from (select item_id, regexp_extract_all(text, '(?s).{1,24}') as parts from benchmark))""",
    "letters": """
    select distinct unnest(string_split(normalized_sentence, '')) as letter from lines""",
    "plan": f"""
    select query, l, 'exact' as kind, 0 as position, 2 * l as score, 0 as g, 0 as o
    from distinct_queries
    union all
    select query, l, 'missing', i, 2 * l - {_indel("i")}, 0, 0
    from (select query, l, unnest(range(1, l + 2))::int as i from distinct_queries)
    union all
    select query, l, 'substitution', i, 2 * (l - 1) - {_sub("i")}, 1, 0
    from (select query, l, unnest(range(1, l + 1))::int as i from distinct_queries)
    union all
    select query, l, 'extra', i, 2 * (l - 1) - {_indel("i")}, 1, 1
    from (select query, l, unnest(range(1, l + 1))::int as i from distinct_queries)""",
    "wildcards": """
    select query, score,
           '%' || case kind when 'exact' then query
                when 'missing' then left(query, position - 1) || '_' || substring(query, position)
                when 'substitution' then left(query, position - 1) || '_' || substring(query, position + 1)
                else left(query, position - 1) || substring(query, position + 1) end || '%' as pattern
    from plan where score > 0""",
    "candidates": """
    select q.query, n.normalized_sentence, n.source_text, n."offset", n.original_sentence
    from distinct_queries q join lines n
      on contains(n.normalized_sentence, left(q.query, (q.l + 1) // 2))
      or contains(n.normalized_sentence, substring(q.query, (q.l + 1) // 2 + 1))""",
    "best": """
    select c.query, c.normalized_sentence, c.source_text, c."offset",
           any_value(c.original_sentence) as original_sentence, max(w.score)::int as score
    from candidates c join wildcards w
      on c.query = w.query and c.normalized_sentence like w.pattern
    group by all""",
    "ranked": """
    select *, row_number() over (partition by query
        order by score desc, normalized_sentence, source_text, "offset")::int as rank
    from best""",
    "results": f"""
    select query_id, query, rank, original_sentence as completed_sentence, source_text, "offset", score
    from admitted join ranked using (query) where rank <= {K}""",
    "variants": """
    select query, kind, position, score, text, g, o, letter
    from (select p.*, letter,
                 case kind when 'exact' then query
                      when 'missing' then left(query, position - 1) || letter || substring(query, position)
                      when 'substitution' then left(query, position - 1) || letter || substring(query, position + 1)
                      else left(query, position - 1) || substring(query, position + 1) end as text
          from plan p join (select letter from letters union all select '') a
            on (kind in ('missing', 'substitution')) = (letter <> ''))
    where not (kind = 'substitution' and letter = substring(query, position, 1))""",
    "ladder": """
    select query, text, score, g, position, o, letter,
           dense_rank() over (partition by query order by score desc)::int as tier
    from (select *, row_number() over (partition by query, text
              order by score desc, g, position, o, letter) as n
          from variants where score > 0 and text <> '' and not contains(text, '  '))
    where n = 1""",
    "tokens": """
    select distinct query as pattern, idx::int as token_pos, token,
           case when idx > 0 and idx < size - 1 then 'whole' when idx > 0 then 'prefix'
                when idx < size - 1 then 'suffix' else 'infix' end as token_class
    from (select query, unnest(words) as token, unnest(range(0, len(words))) as idx, len(words) as size
          from (select query, string_split(query, ' ') as words from distinct_queries))
    where token <> ''""",
    "postings": """
    select distinct unnest(string_split(normalized_sentence, ' ')) as word, line_id from numbered""",
    "vocabulary": "select word, count(*) as df from postings group by word",
    "token_words": """
    select t.token, t.token_class, v.word, v.df
    from (select distinct token, token_class from tokens) t join vocabulary v
      on case t.token_class when 'whole' then v.word = t.token
              when 'prefix' then starts_with(v.word, t.token)
              when 'suffix' then ends_with(v.word, t.token)
              else contains(v.word, t.token) end""",
    "corrections": """
    select query_id, query, text as corrected
    from (select r.query_id, r.query, v.text,
                 row_number() over (partition by r.query_id
                     order by v.g, v.position, v.o, v.letter) as n
          from (select a.query_id, a.query, b.score, b.normalized_sentence
                from admitted a join ranked b using (query)
                where b.rank = 1 and b.score < 2 * length(a.query)) r
          join variants v on v.query = r.query and v.score = r.score
          where v.text <> r.query and v.text <> '' and contains(r.normalized_sentence, v.text))
    where n = 1""",
    "records": """
    select seq, typo, correction
    from (select query_id as seq, unnest(a) as typo, unnest(b) as correction
          from (select query_id, string_split(query, ' ') as a, string_split(corrected, ' ') as b
                from corrections)
          where len(a) = len(b)
          union all
          select query_id, query, corrected from corrections
          where len(string_split(query, ' ')) <> len(string_split(corrected, ' ')))
    where typo <> correction and typo <> '' and correction <> ''""",
    "typos": """
    select typo, arg_max(correction, seq) as correction, count(*) as frequency,
           min(seq) as first_seen
    from records group by typo""",
    "preferred": """
    select query, text, row_number() over (partition by query order by min(idx))::int as place
    from (select p.query, idx,
                 case when idx = 0 then correction else array_to_string(
                     list_concat(words[1:idx - 1], [correction], words[idx + 1:]), ' ') end as text
          from (select query, query as typo, 0 as idx, string_split(query, ' ') as words
                from distinct_queries
                union all
                select query, unnest(words), unnest(range(1, len(words) + 1)), words
                from (select query, string_split(query, ' ') as words from distinct_queries)) p
          join typos using (typo))
    where text <> '' and text <> query
    group by query, text""",
}


def _with(*names: str) -> str:
    """WITH clause of the named relations and all they build on."""
    needed: set[str] = set()

    def add(name: str) -> None:
        if name in needed:
            return
        needed.add(name)
        for other in RELATIONS:
            if other != name and other in _words(RELATIONS[name]):
                add(other)

    for name in names:
        add(name)
    bodies = [
        f"{name} as materialized ({body})" for name, body in RELATIONS.items() if name in needed
    ]
    return "with " + ",\n".join(bodies) + "\n"


def _words(sql: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in sql).split())


def _session_text(chunks: str) -> str:
    return f"""
    select session_id, seq, session_text,
           regexp_replace(session_text, '[{WS}]+', '', 'g') <> '' as fired
    from (select session_id, seq, string_agg(part, '') over (
              partition by session_id, run order by seq) as session_text
          from (select session_id, seq, split_part(chunk, '#', -1) as part,
                       sum(contains(chunk, '#')::int) over (
                           partition by session_id order by seq) as run
                from {chunks} where chunk <> ''))"""


def _admitted(queries: str) -> str:
    """Another relation with `query_text`, normalized."""
    return f"select *, {_norm('query_text')} as query from ({queries})"


def _transcripts() -> str:
    said = "'  ' || text || ' '"

    def alternatives(*items: str) -> str:
        listed = ", ".join(f"{{'transcript': {item}, 'confidence': 0.5}}" for item in items)
        return f"to_json({{'alternative': [{listed}]}})"

    found = f"""case json_type(response)
        when 'OBJECT' then json_extract_string(response, '$.alternative[*].transcript')
        when 'ARRAY' then json_extract_string(response, '$[*]')
        else [json_extract_string(response, '$')] end"""
    return f"""
    with responses as (
      select conv_id * 1000 + turn as recording_id, role = 'user' as by_default, 0 as priority,
             case turn % 3 when 0 then {alternatives(said, "'second'")}
                  when 1 then '{{"alternative":[]}}'::json
                  else {alternatives("'   '", "'other'")} end as response
      from conversations
      union all
      select conv_id * 1000 + turn, role = 'user', 1,
             case turn % 4 when 0 then '{{}}'::json when 1 then to_json([{said}])
                  when 2 then to_json(text) else '{{"alternative":[]}}'::json end
      from conversations),
    heard as (
      select recording_id, priority, by_default,
             coalesce(list_filter(list_transform({found}, lambda x: {_strip("x")}),
                                  lambda x: x <> '')[1], '') as transcript
      from responses)
    select recording_id, transcript,
           case when transcript is null then 'Speech was not recognized. Try speaking clearly '
             || 'for 1-2 seconds and keep the microphone close.' end as error
    from (select recording_id,
                 min_by(transcript, priority) filter (by_default and transcript <> '') as transcript
          from heard group by recording_id)"""


def _held_small(room: int = 30) -> str:
    """Three batches into a table with little room, thinned by a third after the second."""

    def counted(where: str) -> str:
        return f"""select typo, arg_max(correction, seq) as correction, count(*) as frequency, min(seq) as first_seen
            from records cross join bounds where {where} group by typo"""

    def merged(table: str, batch: str) -> str:
        return f"""
        select t.typo, coalesce(c.correction, t.correction) as correction,
               t.frequency + coalesce(c.frequency, 0) as frequency, t.first_seen
        from {table} t left join {batch} c using (typo)
        union all
        select typo, correction, frequency, first_seen
        from (select *, row_number() over (order by first_seen, typo) as n
              from {batch} where typo not in (select typo from {table}))
        where n <= {room} - (select count(*) from {table})"""

    return _with("records") + f"""
    , bounds as (select min(seq) + (max(seq) - min(seq)) // 3 as one, min(seq) + (max(seq) - min(seq)) * 2 // 3 as two from records),
    nothing as (select * from ({counted("false")})),
    c0 as ({counted("seq < one")}), c1 as ({counted("seq >= one and seq < two")}), c2 as ({counted("seq >= two")}),
    t0 as ({merged("nothing", "c0")}),
    t1 as ({merged("t0", "c1")}),
    thin as (
        select * exclude (n, size)
        from (select *, row_number() over (order by frequency, first_seen, typo) as n, count(*) over () as size from t1)
        where n > floor(size * (1.0::double / 3))),
    t2 as ({merged("thin", "c2")})
    select typo, correction, frequency from t2"""


def statements() -> dict[str, str]:
    results = _with("results")
    topk = f"""{results}
    select query_id, rank, completed_sentence, source_text, "offset", score from results"""
    session_relations = _with("lines") + f""",
    typed_chunks as materialized ({RELATIONS["typed_chunks"]}),
    admitted as materialized (
      select * from ({_admitted(
          "select session_id, seq, session_text as query_text from ("
          + _session_text("typed_chunks") + ") where fired")}) where query <> ''),
    """ + ",\n".join(
        f"{name} as materialized ({RELATIONS[name]})"
        for name in ("distinct_queries", "plan", "wildcards", "candidates", "best", "ranked")
    )
    def tree_of(text: str) -> str:
        return _lines(f"""
        select source || '/' || doc_id % 16 as source_text,
               string_agg({text} || chr(10), '' order by doc_id) as text
        from documents group by source, doc_id % 16""")

    tree = tree_of("text")

    def lookup(kind: str) -> str:
        return f"""{_with("token_words")}
        select token, word, df from token_words where token_class = '{kind}'"""

    return {
        "corpus_lines": _with("lines") + "select * from lines",
        "text_tree_scan": tree,
        "text_tree_splits": tree,
        "lossy_text_tree": tree_of("left(text, 10) || chr(65533) || '|' || chr(65533) || '|' || substring(text, 11)"),
        "index_round_trip": topk,
        "typo_json": _with("typos") + "select typo, correction, frequency from typos",
        "corpus_stats": _with("postings") + """
        select (select count(*) from numbered) as sentences,
               (select count(distinct word) from postings) as distinct_words""",
        "corpus_alphabet": _with("letters") + """
        select string_agg(letter, '' order by letter) as alphabet from letters""",
        "normalize_text": f"select doc_id, {_norm('text')} as normalized from documents",
        "admitted_queries": _with("chunks") + f"""
        select session_id, seq, query
        from (select session_id, seq, {_norm("chunk")} as query from chunks) where query <> ''""",
        "penalties": _with("lines") + f"""
        select source_text, "offset", {_sub('"offset"')}::int as substitution,
               {_indel('"offset"')}::int as indel from lines""",
        "scores": _with("lines") + f"""
        select source_text, "offset", (2 * l)::int as exact,
               (2 * (l - 1) - {_sub('"offset"')})::int as substitution,
               (2 * (l - 1) - {_indel('"offset"')})::int as extra,
               (2 * l - {_indel('"offset"')})::int as missing
        from (select *, length(normalized_sentence) as l from lines)""",
        "token_classes": _with("tokens") + "select * from tokens",
        "interior_tokens": _with("distinct_queries") + """
        select query, array_to_string(string_split(query, ' ')[2:-2], '|') as tokens
        from distinct_queries""",
        "edit_pairs": _with("admitted") + f"""
        select query_id, typo, correction
        from (select query_id, unnest(a) as typo, unnest(b) as correction
              from (select query_id, query, wanted, string_split(query, ' ') as a,
                           string_split(wanted, ' ') as b
                    from (select *, {_norm("intended")} as wanted from admitted))
              where query <> '' and wanted <> '' and len(a) = len(b)
              union all
              select query_id, query, wanted
              from (select *, {_norm("intended")} as wanted from admitted)
              where wanted <> ''
                and len(string_split(query, ' ')) <> len(string_split(wanted, ' ')))
        where typo <> correction""",
        "content_hash": "select doc_id, sha256(text) as content_hash from documents",
        "transcripts": _transcripts(),
        "tier_plan": _with("plan") + """
        select distinct l as length, kind, position, score::int as score from plan""",
        "edit_variants": _with("variants") + """
        select query, kind, position, text, score::int as score from variants""",
        "score_ladder": _with("ladder") + """
        select query, text, score::int as score, tier from ladder""",
        "line_ids": _with("numbered") + 'select line_id, source_text, "offset" from numbered',
        "line_lookup": _with("numbered") + """
        select line_id, original_sentence, normalized_sentence, source_text, "offset"
        from numbered
        where line_id in (select max(line_id) from numbered group by source_text)""",
        "postings": _with("postings") + "select word, line_id from postings",
        "vocabulary": _with("vocabulary") + "select word, df from vocabulary",
        "lookup_whole": lookup("whole"),
        "lookup_prefix": lookup("prefix"),
        "lookup_suffix": lookup("suffix"),
        "lookup_infix": lookup("infix"),
        "edge_costs": _with("vocabulary") + """
        , cut as (
          select df, word, unnest(range(1, least(length(word), 32) + 1)) as n
          from vocabulary)
        select 'whole' as token_class, word as edge, 1::bigint as words, df as cost from vocabulary
        union all
        select 'prefix', left(word, n), count(*), sum(df)::bigint from cut group by left(word, n)
        union all
        select 'suffix', right(word, n), count(*), sum(df)::bigint from cut group by right(word, n)""",
        "token_choice": _with("tokens", "token_words") + """
        , costs as (
          select pattern, token_pos, token, cost
          from tokens left join (select token, token_class, sum(df)::bigint as cost
                                 from token_words group by token, token_class)
            using (token, token_class))
        select pattern, token, cost
        from (select *, row_number() over (partition by pattern order by cost, token_pos) as n,
                     count(*) filter (cost is null) over (partition by pattern) as absent
              from costs)
        where n = 1 and absent = 0""",
        "pattern_search": _with("numbered", "distinct_queries") + """
        select query as pattern, line_id
        from distinct_queries join numbered on contains(normalized_sentence, query)""",
        "contains_filter": _with("lines", "distinct_queries") + """
        select query as pattern, source_text, "offset"
        from distinct_queries join lines on contains(normalized_sentence, query)""",
        "half_candidates": _with("lines", "distinct_queries") + """
        select query, pattern, source_text, "offset"
        from (select query, left(query, (l + 1) // 2) as pattern from distinct_queries
              union select query, substring(query, (l + 1) // 2 + 1) from distinct_queries)
        join lines on contains(normalized_sentence, pattern)
        where pattern <> ''""",
        "fuzzy_topk": topk,
        "fuzzy_topk_indexed": topk,
        "fuzzy_topk_by_variants": topk,
        "best_scores": _with("best") + 'select query, source_text, "offset", score from best',
        "rendered_results": results + """
        select query_id, rank,
               'Here are ' || count(*) over (partition by query_id) || ' suggestions:' as header,
               rank || '. ' || completed_sentence || ' (' || source_text || ':' || "offset"
                 || ', score=' || score || ')' as line
        from results""",
        "no_match_queries": _with("admitted", "best") + """
        select query_id, query, 'No suggestions found.' as message
        from admitted where query not in (select query from best)""",
        "typo_mining": _with("corrections") + "select query_id, query, corrected from corrections",
        "typo_counts": _with("typos") + "select * from typos",
        "typo_cap": _with("typos") + "select * from typos order by first_seen, typo limit 20",
        "typo_evict": _with("typos") + """
        select typo, correction, frequency, first_seen
        from (select *, row_number() over (order by frequency, first_seen, typo) as n,
                     count(*) over () as size from typos)
        where n > floor(size * 0.5)""",
        "typo_lookup": _with("tokens", "typos") + """
        select token, correction, frequency
        from (select distinct token from tokens) left join typos on typo = token""",
        "preferred_texts": _with("preferred") + "select query, text, place from preferred",
        "prioritized_variants": _with("ladder", "preferred") + """
        select query, text, score::int as score, preferred,
               row_number() over (partition by query
                   order by score desc, preferred desc, g, position, o, letter)::int as place
        from (select l.*, p.text is not null as preferred
              from ladder l left join preferred p on l.query = p.query and l.text = p.text)""",
        "session_text": _with("chunks") + _session_text("chunks"),
        "session_completions": session_relations + f"""
        select session_id, seq, query_text as echo, rank,
               original_sentence as completed_sentence, source_text, "offset", score
        from admitted join ranked using (query) where rank <= {K}""",
        "session_transcript": session_relations + f""",
        found as (
          select session_id, seq, query_text, rank, original_sentence, source_text, "offset", score
          from admitted join ranked using (query) where rank <= {K}),
        fired as (
          select session_id, seq, session_text as query_text
          from ({_session_text("typed_chunks")}) where fired),
        counted as (
          select f.session_id, f.seq, f.query_text, count(rank)::int as n
          from fired f left join found r on f.session_id = r.session_id and f.seq = r.seq group by all)
        select session_id, seq, 0 as place,
               case n when 0 then 'No suggestions found.' else 'Here are ' || n || ' suggestions:' end as line
        from counted
        union all
        select session_id, seq, rank,
               rank || '. ' || original_sentence || ' (' || source_text || ':' || "offset" || ', score=' || score || ')'
        from found
        union all
        select session_id, seq, n + 1, query_text from counted""",
        "consecutive_dedup": _with("lines") + """
        select source_text, "offset", content_hash
        from (select *, lag(content_hash) over (partition by source_text order by "offset") as before
              from (select *, sha256(original_sentence) as content_hash from lines))
        where content_hash is distinct from before""",
        "recording_dedup": """
        select source, doc_id, content_hash
        from (select *, lag(content_hash) over (partition by source order by doc_id) as before
              from (select source, doc_id, sha256(text) as content_hash from documents))
        where content_hash is distinct from before""",
        "streaming_session_text": _with("chunks") + _session_text("chunks"),
        "streaming_typo_counts": _with("typos") + "select * from typos",
        "typo_table_held_small": _held_small(),
        "streaming_completions": topk,
    }
