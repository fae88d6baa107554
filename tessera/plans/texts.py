"""Text, extraction, matching and vector functions over whole columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract, text, vector
from ..operators.match import match_terms
from ..operators.search import compared, near_hashes
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql
_no_space = "regexp_replace({}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}\\x{{FEFF}}\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{205F}}\\v]+', ' ', 'g')"


def clean_sql(column: str) -> str:
    """sanitize() in SQL."""
    x = f"regexp_replace(coalesce({column}, ''), '<[^>]*>', ' ', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"regexp_replace({x}, '{entity}', '{sign}', 'gi')"
    return f"trim({_no_space.format(x)})"


_title = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[\\x{1F300}-\\x{1FFFF}]', '', 'g'), '\\s*\\((?:m/w/d|remote|all\\s+levels?|anywhere|f/m/d|all\\s+genders?)\\)', '', 'gi'), '\\s*\\[(?:remote|contract|full[- ]?time|part[- ]?time)\\]', '', 'gi'), '\\s{2,}', ' ', 'g'))"

_firm = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\\s*\\b(inc\\.?|ltd\\.?|llc\\.?|corp\\.?|gmbh|s\\.?a\\.?|b\\.?v\\.?)\\s*[,.|]*\\s*$', '', 'i'), '[,.|]+$', ''), '\\s{{2,}}', ' ', 'g'))"
_units = "flatten(list_transform(range(1, length({0}) + 1), lambda i: case when ord(substr({0}, i::int, 1)) < 65536 then [ord(substr({0}, i::int, 1))] else [55296 + ((ord(substr({0}, i::int, 1)) - 65536) >> 10), 56320 + ((ord(substr({0}, i::int, 1)) - 65536) & 1023)] end))"
#: The lossy hash in SQL: the product is rounded to a double, and its remainder is taken from 0 up.
_fold = "lpad(lower(to_hex(list_reduce(list_prepend(2166136261::bigint, list_transform({}, lambda u: u::bigint)), lambda h, c: ((fmod((case when xor(h, c) >= 2147483648 then xor(h, c) - 4294967296 else xor(h, c) end)::double * 16777619.0, 4294967296.0) + 4294967296.0)::bigint % 4294967296)))), 8, '0')"

#: Vectors as doubles with their lengths, and the cosines of every query with every vector.
_lengths = "n as (select vec_id, label, embedding::double[] e, sqrt(list_dot_product(embedding::double[], embedding::double[])) l from embeddings)"
_asked = f"{_lengths}, s as (select q.vec_id as query, e.vec_id, e.label, round(list_dot_product(q.e, e.e) / (q.l * e.l), 6) sim from n q, n e where q.vec_id % 20 = 0)"


@R.add("sx01_sanitize", f"select row_id, {clean_sql('content')} clean from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", text.sanitize(F.col("content")).alias("clean"))


@R.add("sx07_titles", f"select row_id, {_title} title from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", text.normal_title(F.col("title")).alias("title"))


@R.add("sx06_companies", f"select {_firm.format('company')} company, count(*) n from raw_jobs group by 1")
def _(t):
    return t("raw_jobs").select(text.normal_company(F.col("company")).alias("company")).groupBy("company").agg(F.count("*").alias("n"))


@R.add("dd06_hashes", f"with k as (select row_id, regexp_replace(lower({_firm.format('company')}), '\\s+', ' ', 'g') || '::' || regexp_replace(lower({_title}), '\\s+', ' ', 'g') k, substr(coalesce(content, ''), 1, 500) c, trim(lower(coalesce(list_filter(categories, lambda x: regexp_matches(x, '(?i)remote|hybrid|onsite|india|europe|worldwide'))[1], ''))) p from raw_jobs), s as (select row_id, k || '::' || c a, k b, k || '::' || p d from k) select row_id, {_fold.format(_units.format('a'))} content_hash, {_fold.format(_units.format('b'))} similarity_hash, {_fold.format(_units.format('d'))} identity_hash from s")
def _(t):
    key = text.dedupe_key(F.col("title"), F.col("company"))
    content = F.substring(F.coalesce("content", F.lit("")), 1, 500)
    place = F.coalesce(F.try_element_at(F.filter("categories", lambda c: c.rlike("(?i)remote|hybrid|onsite|india|europe|worldwide")), F.lit(1)), F.lit(""))
    hashed = {"content_hash": F.concat(key, F.lit("::"), content), "similarity_hash": key, "identity_hash": F.concat(key, F.lit("::"), F.trim(F.lower(place)))}
    return t("raw_jobs").select("row_id", *[text.lossy_fnv(v).alias(k) for k, v in hashed.items()])


@R.add("dd07_exact_fnv", "select name, list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(name, ''), lambda c: ord(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::bigint hash from known_names where max(ord(name)) < 65536 or true group by name".replace(" where max(ord(name)) < 65536 or true group by name", ""))
def _(t):
    return t("known_names").select("name", text.fnv1a32(F.col("name")).alias("hash"))


_word_hash = "case when {0} = '' then 0 when len({1}) = 0 then 2166136261 else list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(array_to_string(list_transform({1}, lambda w, i: repeat(w, case when i <= 10 then 3 else 1 end)), ''), ''), lambda c: ord(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::bigint end"
_kept = "list_slice(list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda w: length(w) > 2), 1, 50)"
_hashed = f"select row_id, fetched_at, {_word_hash.format('s', 'ws')} h from (select *, {_kept.format('s')} ws from (select row_id, fetched_at, concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(contentsnippet, '')) s from raw_jobs))"


def _word_hashed(t):
    both = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "company", "contentsnippet")])
    return t("raw_jobs").select("row_id", "fetched_at", text.word_hash(both).alias("h"))


@R.add("dd07_word_hash", f"select row_id, h from ({_hashed})")
def _(t):
    return _word_hashed(t).select("row_id", "h")


@R.add("dd03_cluster_earliest", f"select h, row_id, cluster_size from (select h, row_id, count(*) over (partition by h) cluster_size, row_number() over (partition by h order by fetched_at nulls last, row_id) n from ({_hashed})) where n = 1 and cluster_size > 1")
def _(t):
    first = F.min(F.struct(F.col("fetched_at").isNull().alias("no"), "fetched_at", "row_id")).alias("m")  # combined before the shuffle
    return _word_hashed(t).groupBy("h").agg(first, F.count("*").alias("cluster_size")).where("cluster_size > 1").select("h", "m.row_id", "cluster_size")


@R.add("dd08_hamming", "with h as (select entity_id, cast('0x' || substr(md5(name), 1, 8) as bigint) h from known_names where kind = 'org') select a.entity_id as query, b.entity_id as other, bit_count(xor(a.h, b.h))::int d from h a, h b where a.entity_id % 20 = 0 and a.entity_id <> b.entity_id")
def _(t):
    h = t("known_names").where("kind = 'org'").select("entity_id", F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("bigint").alias("h"))
    q = h.where("entity_id % 20 = 0").select(F.col("entity_id").alias("query"), F.col("h").alias("g"))  # the stated query set of a table of fixed size
    return q.join(h, F.col("query") != F.col("entity_id")).select("query", F.col("entity_id").alias("other"), text.hamming(F.col("g"), F.col("h")).alias("d"))


@R.add("dd09_near_hashes", "with h as (select name, cast('0x' || substr(md5(name), 1, 8) as bigint) h from known_names where kind = 'org') select a.name a, b.name b, bit_count(xor(a.h, b.h))::int d from h a join h b on a.name < b.name where bit_count(xor(a.h, b.h)) <= 5")
def _(t):
    n = t("known_names").where("kind = 'org'").select("name", F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("bigint").alias("h"))
    return near_hashes(n, "name", "h")


@R.add("dd10_near_vectors", f"with {_lengths}, s as (select a.vec_id a, b.vec_id b, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) sim from n a join n b on a.vec_id < b.vec_id) select a, b, sim from s where sim >= 0.88")
def _(t):
    e = t("embeddings")
    return compared(e, e, least=0.88).select(F.col("query").alias("a"), F.col("vec_id").alias("b"), "sim")


@R.add("sx05_dice", "with n as (select entity_id, regexp_replace(lower(name), '\\s+', '', 'g') s, split_part(name, ' ', 1) head from known_names), p as (select a.entity_id x, b.entity_id y, a.s sa, b.s sb from n a join n b on a.head = b.head and a.entity_id < b.entity_id), g as (select x, y, 0 side, substr(sa, i::int, 2) g from (select x, y, sa, unnest(range(1, length(sa))) i from p) union all select x, y, 1, substr(sb, i::int, 2) from (select x, y, sb, unnest(range(1, length(sb))) i from p)), c as (select x, y, g, count(*) filter (side = 0) ca, count(*) filter (side = 1) cb from g group by all), s as (select x, y, sum(least(ca, cb)) m from c group by all) select p.x, p.y, round(case when sa = sb then 1 else 2.0 * m / (length(sa) + length(sb) - 2) end, 6) dice from p join s on p.x = s.x and p.y = s.y")
def _(t):
    n = t("known_names").select("entity_id", "name", F.split_part("name", F.lit(" "), F.lit(1)).alias("head"))
    b = n.select(F.col("entity_id").alias("y"), F.col("name").alias("other"), "head")
    return n.withColumnRenamed("entity_id", "x").join(b, "head").where("x < y").select("x", "y", F.round(text.dice(F.col("name"), F.col("other")), 6).alias("dice"))


_cut = "case when {i} + 200 >= length(s) then length(s) when regexp_matches({w}, '(?s)^.{{41}}.* ') then {i} + length(regexp_extract({w}, '(?s)^(.{{41}}.*) ', 1)) else {i} + 200 end"


@R.add("sx14_chunks", f"""with recursive d as (select row_number() over () k, doc_id, trim({_no_space.format("coalesce(text, '')")}) s from documents),
r as (select k, 0 n, 0 i, case when length(s) <= 200 then length(s) else {_cut.format(i='0', w='substr(s, 1, 201)')} end e from d where s <> ''
  union all select k, n + 1, x, {_cut.format(i='x', w='substr(s, x + 1, 201)')} from (select r.k, n, s, case when e - 40 > i then e - 40 else e end x from r join d on r.k = d.k where length(s) > 200) where x < length(s)),
p as (select r.k, doc_id, n, trim(substr(s, i + 1, e - i), ' ') as chunk from r join d on r.k = d.k)
select doc_id, (row_number() over (partition by k order by n) - 1)::int as chunk_no, chunk from p where chunk <> ''""")
def _(t):
    return t("documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_no", "chunk"))


@R.add("sx15_tokens", f"select row_id, len(list_filter(string_split(trim({_no_space.format('coalesce(title, chr(32))')}), ' '), lambda x: x <> ''))::int n from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", F.size(text.words(F.coalesce("title", F.lit(" ")))).alias("n"))


@R.add("sx16_truncated", "select row_id, case when length(content) > 120 then substr(content, 1, 119) || '…' else content end short from raw_jobs")
def _(t):
    return t("raw_jobs").select("row_id", text.truncate(F.col("content"), 120).alias("short"))


@R.add("sx22_domains", "select nullif(regexp_replace(lower(regexp_extract(sourceurl, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '') as domain, count(*) n from raw_jobs where sourceurl is not null group by 1")
def _(t):
    return t("raw_jobs").where("sourceurl is not null").groupBy(text.domain(F.col("sourceurl")).alias("domain")).agg(F.count("*").alias("n"))


@R.add("sx23_base_domains", "select nullif(array_to_string(list_slice(string_split(h, '.'), -2, -1), '.'), '') as base, count(*) n from (select lower(regexp_extract(sourceurl, '^https?://([^/:?#]+)', 1)) h from raw_jobs where sourceurl is not null) group by 1")
def _(t):
    return t("raw_jobs").where("sourceurl is not null").groupBy(text.base_domain(text.host(F.col("sourceurl"))).alias("base")).agg(F.count("*").alias("n"))


@R.add("sx11_matcher", "select k keyword, count(*) n from (select lower(coalesce(content, '')) c from raw_jobs) join (select unnest(['python', 'java', 'scala', 'rust', 'kafka', 'docker', 'graphql', 'c++', 'c#', '.net', 'node.js']) k) on regexp_matches(c, '(^|[^a-z0-9_' || case when k[1] in ('+', '.', '-') then '+.\\-' else '' end || '])' || regexp_replace(k, '([.+#])', '\\\\\\1', 'g') || '($|[^a-z0-9_' || case when k[-1] in ('+', '.', '-') then '+.\\-' else '' end || '])') group by k")
def _(t):
    keys = ["python", "java", "scala", "rust", "kafka", "docker", "graphql", "c++", "c#", ".net", "node.js"]
    return t("raw_jobs").select(F.explode(match_terms(F.col("content"), keys)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@R.add("flt02_prefilter", "select row_id from (select row_id, (regexp_matches(lower(coalesce(title, '')), '(^|[^a-z0-9_])(data|platform)($|[^a-z0-9_])')) t, (regexp_matches(c, '(^|[^a-z0-9_])kafka($|[^a-z0-9_])'))::int + (regexp_matches(c, '(^|[^a-z0-9_])spark($|[^a-z0-9_])'))::int + (regexp_matches(c, '(^|[^a-z0-9_])docker($|[^a-z0-9_])'))::int n from (select *, lower(coalesce(content, '')) c from raw_jobs)) where t or n >= 2")
def _(t):
    hit = lambda col, k: F.lower(F.coalesce(col, F.lit(""))).rlike(extract.keyword_pattern(k))
    titled = hit("title", "data") | hit("title", "platform")
    n = sum((hit("content", k).cast("int") for k in ("kafka", "spark", "docker")), F.lit(0))
    return t("raw_jobs").where(titled | (n >= 2)).select("row_id")


@R.add("sc01_experience", "select row_id, case when r1 <> '' then r1::int else nullif(s, '')::int end low, case when r1 <> '' then r2::int end high from (select row_id, regexp_extract(content, '([1-9][0-9]?)\\s*(?:[-–to]+)\\s*([1-9][0-9]?)\\s+years?', 1, 'i') r1, regexp_extract(content, '([1-9][0-9]?)\\s*(?:[-–to]+)\\s*([1-9][0-9]?)\\s+years?', 2, 'i') r2, regexp_extract(content, '(?:at\\s+least\\s+|minimum\\s+|min\\.?\\s+)?([1-9][0-9]?)\\+?\\s+years?', 1, 'i') s from raw_jobs where content is not null) where r1 <> '' or s <> ''")
def _(t):
    e = extract.experience_years(F.col("content"))
    return t("raw_jobs").where("content is not null").select("row_id", e.alias("e")).where("e is not null").select("row_id", F.col("e.min").alias("low"), F.col("e.max").alias("high"))


@R.add("sc03_arrangement", "select case when regexp_matches(c, '(^|[^a-z0-9_])hybrid($|[^a-z0-9_])') or regexp_matches(c, '(^|[^a-z0-9_])[0-9]+\\s+days?\\s+(in|from)\\s+office($|[^a-z0-9_])') then 'hybrid' when regexp_matches(c, '(^|[^a-z0-9_])(fully\\s+remote|100%\\s+remote|remote[-\\s]?first|work\\s+from\\s+(home|anywhere)|wfh|distributed)($|[^a-z0-9_])') then 'remote' when regexp_matches(c, '(^|[^a-z0-9_])remote($|[^a-z0-9_])') and not regexp_matches(c, '(^|[^a-z0-9_])(no\\s+remote|remote\\s+not)($|[^a-z0-9_])') then 'remote' when regexp_matches(c, '(^|[^a-z0-9_])(on[-\\s]?site|in[-\\s]?office|in[-\\s]?person|no\\s+remote)($|[^a-z0-9_])') then 'onsite' else 'unknown' end arrangement, count(*) n from (select lower(coalesce(content, '')) c from raw_jobs) group by 1")
def _(t):
    return t("raw_jobs").groupBy(extract.work_arrangement(F.col("content")).alias("arrangement")).agg(F.count("*").alias("n"))


def alone_sql(pattern: str, column: str) -> str:
    """extract.alone() in SQL."""
    return f"regexp_matches({column}, '(^|[^a-z0-9_])({pattern})($|[^a-z0-9_])')"


_level = "case " + " ".join(f"when {alone_sql(p, 'c')} then '{n}'" for n, p in extract.LEVELS) + " else 'unknown' end"


@R.add("sc05_seniority", f"select {_level} seniority, count(*) n from (select lower(concat_ws(' ', coalesce(title, ''), coalesce(content, ''))) c from raw_jobs) group by 1")
def _(t):
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return t("raw_jobs").groupBy(extract.seniority(both).alias("seniority")).agg(F.count("*").alias("n"))


@R.add("sc08_tf_idf", f"with x as (select row_id, list_filter(string_split(trim({_no_space.format('lower(title)')}), ' '), lambda w: w <> '') ws from raw_jobs where title is not null), n as (select count(*) n, count(*) filter (list_contains(ws, 'data')) df from x where len(ws) > 0) select row_id, round(len(list_filter(ws, lambda w: w = 'data')) / len(ws) * (ln((greatest(n, 1) + 1) / (df + 1)) + 1), 6) score from x, n where list_contains(ws, 'data')")
def _(t):
    x = t("raw_jobs").where("title is not null").select("row_id", text.words(F.lower("title")).alias("ws"))
    totals = x.where(F.size("ws") > 0).agg(F.count("*").alias("n"), F.count_if(F.array_contains("ws", "data")).alias("df"))  # one row
    return x.where(F.array_contains("ws", "data")).join(F.broadcast(totals)).select("row_id", F.round(extract.tf_idf(F.col("ws"), "data", F.col("n"), F.col("df")), 6).alias("score"))


@R.add("sc20_skills", "select label, count(*) n from (select unnest(list_filter([" + ", ".join(f"case when {alone_sql(p, 'c')} then '{n}' end" for n, p in extract.TECHNIQUES.items()) + "], lambda x: x is not null)) as label from (select lower(coalesce(content, '')) c from raw_jobs)) group by label")
def _(t):
    return t("raw_jobs").select(F.explode(extract.techniques(F.col("content"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@R.add("vc01_cosine_to_first", "with q as (select embedding e from embeddings where vec_id = 0) select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * q.e[i]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.e, lambda x: x::double * x::double)))), 6) sim from embeddings, q")
def _(t):
    e = t("embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.join(F.broadcast(q)).select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


@R.add("vc02_top_per_label", "with q as (select embedding e from embeddings where vec_id = 0), s as (select vec_id, label, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * q.e[i]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.e, lambda x: x::double * x::double)))) sim from embeddings, q), r as (select *, row_number() over (partition by label order by sim desc, vec_id) n from s) select label, vec_id, n from r where n <= 5")
def _(t):
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.join(F.broadcast(q)).select("vec_id", "label", vector.cosine(F.col("embedding"), F.col("q")).alias("sim"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), "vec_id")).cast("long")).where("n <= 5").select("label", "vec_id", "n")


@R.add("vc03_top_per_query", f"with {_asked}, r as (select *, row_number() over (partition by query order by sim desc, vec_id) n from s) select query, vec_id, sim, n from r where n <= 10")
def _(t):
    e = t("embeddings")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id")
    best = compared(e.withColumn("label", F.lit(0)), e.where("vec_id % 20 = 0"), k=10)
    return best.withColumn("n", F.row_number().over(w).cast("long")).where("n <= 10").select("query", "vec_id", "sim", "n")


@R.add("vc04_top_per_query_and_label", f"with {_asked}, r as (select *, row_number() over (partition by query, label order by sim desc, vec_id) n from s) select query, label, vec_id, n from r where n <= 5")
def _(t):
    e = t("embeddings")
    w = Window.partitionBy("query", "label").orderBy(F.desc("sim"), "vec_id")
    best = compared(e, e.where("vec_id % 20 = 0"), k=5)
    return best.withColumn("n", F.row_number().over(w).cast("long")).where("n <= 5").select("query", "label", "vec_id", "n")


@R.add("dt04_weeks", "select w as week_start_day, count(*) n from (select (epoch_us(fetched_at) // 86400000000) - ((epoch_us(fetched_at) // 86400000000 + 4) % 7) w from raw_jobs where fetched_at is not null) group by 1")
def _(t):
    d = F.floor(F.unix_micros("fetched_at") / 86_400_000_000)
    return t("raw_jobs").where("fetched_at is not null").groupBy((d - F.pmod(d + 4, F.lit(7))).alias("week_start_day")).agg(F.count("*").alias("n"))


@R.add("js01_props", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.add("prj01_normalise", f"with x as (select *, coalesce(nullif(trim(link), ''), nullif(trim(url), '')) l, coalesce(nullif(trim(company), ''), nullif(trim(creator), '')) f from raw_jobs) select row_id, coalesce(case when trim(id) <> '' then id end, case when trim(link) <> '' then link end, case when trim(url) <> '' then url end, '') id, coalesce(case when trim(link) <> '' then link end, case when trim(url) <> '' then url end, '') link, {_title} title, {_firm.format('case when trim(company) <> chr(32)[2:] then company when trim(creator) <> chr(32)[2:] then creator end')} company, substr(coalesce(content, ''), 1, 500) snippet, coalesce(categories, []) categories from raw_jobs")
def _(t):
    j = t("raw_jobs")
    link = F.coalesce(text.blank_to_null(F.col("link")), text.blank_to_null(F.col("url")), F.lit(""))
    content = F.coalesce("content", F.lit(""))
    return j.select(
        "row_id", F.coalesce(text.blank_to_null(F.col("id")), link).alias("id"), link.alias("link"), text.normal_title(F.col("title")).alias("title"),
        text.normal_company(F.coalesce(text.blank_to_null(F.col("company")), text.blank_to_null(F.col("creator")))).alias("company"),
        F.substring(content, 1, 500).alias("snippet"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )


def _batch(minute: int, parts: int) -> int:
    return (minute % 15) // 5 % parts


@R.add("flt09_minute_batch", "select url from (select url, row_number() over (order by url) - 1 i, count(*) over () c from source_registry) where floor(i / ceil(c / 3.0)) = 1")
def _(t):
    w = Window.orderBy("url")  # a table of fixed size
    x = t("source_registry").select("url", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("c"))
    return x.where(F.floor(F.col("i") / F.ceil(F.col("c") / 3.0)) == _batch(7, 3)).select("url")
