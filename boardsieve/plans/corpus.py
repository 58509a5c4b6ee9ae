"""Posting view over the given tables, as Spark expressions and as SQL text.

The given tables hold no postings, so each order becomes one: the buyer is the
company, the order date the posting date, a document the description, and
title, place, tags and salary are picks from the lists below.  The same rule is
written twice, once for Spark and once as SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsieve.functions.fixed_values import BOARDS
from boardsieve.session import configure

AS_OF = "2001-08-02 00:00:00"
PIPE_MAX_AGE = 365  # the dates are spread over years; 14 days would leave few rows

TITLES = (
    "Senior Full Stack Web Developer – React (m/w/d)", "Frontend Developer",
    "Python Developer (m/w/d) - Backend & Data Engineering", "Data Engineer",
    "Principal ML Engineer - Embodied AI Scaling Foundations",
    "Senior Java Backend Engineer (Core Java, Trading Systems)",
    "Senior Fullstack Developer - Java EE/Spring/Angular/React",
    "Senior Backend Developer - C#.NET (m/w/d)", "SOFTWARE DEVELOPER AL / C/AL / MS Navision BC 365",
    "Lead Developer / Fullstack-Entwickler (m/w/d) — Vue/Nuxt/TS", "Full Stack Engineer",
    "Senior Software Engineer", "Backend Developer", "Junior Backend Engineer",
    "Software Engineer, iOS Core Product", "Electrodynamics Engineer - Remote",
    "Research Engineer, Societal Impacts", "SVP, Data Product & Insights - Life Sciences",
    "Product Designer, Growth", "Django Developer", "Go Developer", "Golang Engineer",
    "  Node.js Developer (Mid-Level)\t", "Intern", "Intern Software Engineer", "Internal Tools Engineer",
    "International Web Engineer", "Office Assistant", "Ruby on Rails Engineer", "Staff Engineer, GraphQL Platform",
    "Accessibility Engineer (WCAG)", "PHP Developer / Symfony", "Kubernetes Engineer", "C++ Developer",
    "C# dev with React", "Rust Engineer", "TypeScript Developer", "Technical Lead - FastAPI",
    "AI Engineer - LLM & RAG", "Salesforce Developer", "Sales Manager", "Policy Analyst",
    "HR Manager", "Head of Engineering, Vue.js", "Software Engineer - MongoDB", "Web Developer",
    "Data Scientist", "Praktikum Softwareentwicklung", "Android Developer", "Principal Engineer, Search",
    "Quantitative Developer", "Platform Developer", "Communications Engineer",
)
LOCATIONS = (
    "Worldwide", "Remote", "Berlin", "Berlin, Germany", "13086 Berlin, Germany", "Hamburg, Deutschland",
    "Remote - US", "Focus Town", "London", "London, EU", "USA", "United States", "Remote (Europe)",
    "EU / UK", "EMEA", "Paris, France", "Madrid, Spain, Remote", "Lisbon, Portugal", "Amsterdam, Netherlands",
    "Work from anywhere", "Global", "Anywhere in the world", "Toronto, Canada", "Remote, UK", "US only",
    "UK-based", "Essential Services Park", "New York", "Bangalore, India", "Remote - Canada (or Poland)",
    "  Munich  ", "Vienna, Austria (Hybrid)", "On-site", "München", None, "Dublin, Ireland",
    "Switzerland", "1010 Wien, Austria", "Remote, Germany", "Home office", "Distributed", "Latin America", "",
)
TAGS = (
    "python,django", "react, typescript", "java,spring", "", "c#,.net", " vue , nuxt ,,", "sales,crm",
    "node.js,graphql,docker", "remote,worldwide", "php", "rust,systems", "go,kubernetes", "eu team,remote",
    "ngo,open source", "java,react", "spain", "redis,mysql,rest api", "germany", "ruby,rails,rspec",
    "intern,junior", "llm,rag,langchain", "tailwindcss,next.js,node,postgres,jest,vitest,stripe,ci/cd", "salesforce",
)
SALARIES = (
    None, "$120,000 – $150,000", "50.000€", "€4,500/month", "competitive", "", "55000", "9999",
    "£60k", ". negotiable", "70,000+ EUR", "Up to 45,000", "3000",
)
LEADS = (
    "", "We are a mission-driven team working on civic tech and open source. ",
    "Must be based in Germany. ", "You must reside in the US. ", "Fully remote, work from anywhere. ",
    "Remote within Europe. ", "Our saas platform is venture-backed. ",
    "Human rights and press freedom advocacy. ", "Candidates living in Portugal or Spain preferred. ",
    "Python, Docker and PostgreSQL. ", "Work from home with a distributed team. ",
    "Series A funded marketplace. ", "uk only role. ", "Office in Berlin, hybrid possible. ",
    "Policy, transparency and digital rights. ", "React and Next.js with GraphQL. ",
    "Located in Warsaw, Poland. ", "us only. Worldwide team. ", "Kubernetes, Terraform, Ansible. ",
)
COMPANY_SUFFIXES = (
    "", " Foundation", "", " GmbH", " Humanitarian Aid", "", " SaaS Platform", " Mozilla Labs",
    "", " Effective Software", " Non-Profit", "  ", " Charity (series a)", " Greenpeace",
)
SCOPES = (None, None, "eu", None, "worldwide", None, "unknown", "germany", None, "restricted")


# Tables worth spreading when their file cannot be split, and the key to spread on.
_SPREAD_KEY = {"orders": "o_orderkey", "documents": "doc_id", "pages": "page_id", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.

    A file with a single row group is one task however many cores there are.  Only a
    scan of one split, which is at most one split's bytes, is redistributed.
    """
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _SPREAD_KEY and df.rdd.getNumPartitions() == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism, _SPREAD_KEY[name])
    return df


def _pick(values: tuple, index: Column) -> Column:
    literals = F.array(*[F.lit(x).cast("string") for x in values])
    return F.get(literals, F.pmod(index, F.lit(len(values))).cast("int"))


#: Rows of one task that makes pages: their texts take about 50 MB.
TASK_ROWS = 20_000


def _with_text_by_page(rows: DataFrame, documents: DataFrame, doc_count: Column, page: int, n_rows: int, n_docs: int) -> DataFrame:
    """Rows with the text of their document, all rows of a page of ``page`` consecutive keys in one task; adds ``page_group``.

    Documents are dealt to keys in turn, so those of a page lie next to each other.  Rows travel by the stretch
    of documents their page starts in, documents to each stretch whose pages may reach them: only narrow rows and
    documents are shuffled, and no text once per row.  Few documents are copied for several parts of the rows.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))
    copies = max(1, -(-2 * tasks * page // max(n_docs, 1)))
    number = F.floor(F.col("k") / page)
    stretch = F.floor(F.pmod(number * page, doc_count) / page)
    rows = rows.withColumn("page_group", stretch * copies + F.pmod(number, F.lit(copies)))
    d = F.col("doc_id")
    reached = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(page - 1)), lambda back: F.floor(F.pmod(d - back, doc_count) / page)))
    groups = F.flatten(F.transform(reached, lambda g: F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: g * copies + i)))
    texts = documents.filter((d >= 0) & (d < doc_count)).select(F.explode(groups).alias("text_group"), d.alias("text_doc"), "text")
    rows = rows.repartition(tasks, "page_group")
    texts = texts.repartition(tasks, "text_group")
    # Both sides lie by group; the rest of the condition is no key, so that neither moves again.
    same = (F.col("page_group") == F.col("text_group")) & ((F.col("doc_id") - F.col("text_doc")) == 0)
    return rows.join(texts, same, "left")


def raw_postings(spark: SparkSession, sf_dir: str, page: int | None = None) -> DataFrame:
    """Postings as a board would deliver them: padded text, comma-separated tags.

    With ``page`` each page of so many consecutive keys lies in one task, told by the further column ``page_group``.
    """
    configure(spark)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_orderdate")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    k, c = F.col("k"), F.col("c")
    rows = orders.join(customers, "c").join(nations, "c_nationkey")
    if page is None:
        doc_count = documents.agg(F.count(F.lit(1))).scalar()
        joined = rows.withColumn("doc_id", F.pmod(k, doc_count)).join(documents, "doc_id", "left")
    else:
        n_rows, n_docs = (spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in ("orders", "documents"))
        doc_count = F.lit(n_docs).cast("long")
        joined = _with_text_by_page(rows.withColumn("doc_id", F.pmod(k, doc_count)), documents, doc_count, page, n_rows, n_docs)
    return joined.select(
        *([] if page is None else ["page_group"]),
        k.alias("ingest_seq"),
        _pick(TITLES, k % 7 + c).alias("title"),
        F.when(k % 29 == 0, F.lit("Unknown"))
        .otherwise(F.concat(F.col("c_name"), _pick(COMPANY_SUFFIXES, c))).alias("company"),
        F.coalesce(_pick(LOCATIONS, k % 3 + c), F.initcap("n_name")).alias("location"),
        (k % 3 != 0).alias("is_remote"),
        _pick(SCOPES, k).alias("remote_scope"),
        F.concat(F.lit("https://boards.example.org/p/"),
                 (k - F.when(k % 11 == 0, 1).otherwise(0)).cast("string")).alias("url"),
        F.when(k % 13 != 0, F.concat(_pick(LEADS, k), F.col("text"))).alias("description"),
        _pick(SALARIES, k).alias("salary"),
        _pick(TAGS, k).alias("tags_csv"),
        _pick(BOARDS, k).alias("source"),
        F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("posted_at"),
        (F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(F.lit(0), (k % 240).cast("int"))).alias("fetched_at"),
    )


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values) + "]"


def _sql_pick(values: tuple, index: str) -> str:
    return f"({_sql_list(values)})[(({index}) % {len(values)}) + 1]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


RAW_SQL = f"""
raw_postings AS (
  SELECT o.o_orderkey AS ingest_seq,
    {_sql_pick(TITLES, 'o.o_orderkey % 7 + o.o_custkey')} AS title,
    CASE WHEN o.o_orderkey % 29 = 0 THEN 'Unknown'
         ELSE cu.c_name || {_sql_pick(COMPANY_SUFFIXES, 'o.o_custkey')} END AS company,
    coalesce({_sql_pick(LOCATIONS, 'o.o_orderkey % 3 + o.o_custkey')},
             upper(n.n_name[1]) || lower(n.n_name[2:])) AS location,
    o.o_orderkey % 3 <> 0 AS is_remote,
    {_sql_pick(SCOPES, 'o.o_orderkey')} AS remote_scope,
    'https://boards.example.org/p/' || (o.o_orderkey - CASE WHEN o.o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS url,
    CASE WHEN o.o_orderkey % 13 <> 0 THEN {_sql_pick(LEADS, 'o.o_orderkey')} || d.text END AS description,
    {_sql_pick(SALARIES, 'o.o_orderkey')} AS salary,
    {_sql_pick(TAGS, 'o.o_orderkey')} AS tags_csv,
    {_sql_pick(BOARDS, 'o.o_orderkey')} AS source,
    CASE WHEN o.o_orderkey % 7 <> 0 THEN CAST(o.o_orderdate AS TIMESTAMP) END AS posted_at,
    TIMESTAMP '{AS_OF}' - to_hours(CAST(o.o_orderkey % 240 AS INTEGER)) AS fetched_at
  FROM orders o
  JOIN customer cu ON cu.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = cu.c_nationkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
)"""

POSTINGS_SQL = RAW_SQL + f""",
postings AS (
  SELECT * REPLACE ({sql_strip('title')} AS title, {sql_strip('company')} AS company),
    list_filter(list_transform(string_split(tags_csv, ','), lambda t: trim(t)), lambda t: t <> '') AS tags,
    sha256(url) AS id,
    sha256(lower({sql_strip('title')}) || '|' || lower({sql_strip('company')}) || '|' || lower({sql_strip('location')})) AS content_hash
  FROM raw_postings
)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in record form: stripped, tags split, both keys derived."""
    from boardsieve.operators.normalise import finish, split_tags

    raw = raw_postings(spark, sf_dir)
    return finish(raw.withColumn("tags", split_tags(F.col("tags_csv"))).drop("tags_csv"))


def as_of() -> Column:
    """The fixed 'now' of all demo queries."""
    return F.to_timestamp(F.lit(AS_OF))


_PROFILES: dict[tuple[str, str], DataFrame] = {}


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile trained on all labelled documents, once per session and folder."""
    from boardsieve.operators.language import train_profile

    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PROFILES:
        _PROFILES[key] = train_profile(table(spark, sf_dir, "documents"))
    return _PROFILES[key]
