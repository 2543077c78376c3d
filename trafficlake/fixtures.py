"""Traffic views derived from the generated tables.

Each view is one SQL text that Spark and DuckDB both accept; ``{us}`` stands for the dialect's
"timestamp to epoch microseconds". :class:`Tables` builds them lazily for Spark, :func:`with_views`
turns them into CTEs for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SPARK_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DUCK_US = "epoch_us(ts)"

VIEWS: dict[str, str] = {
    "llm_requests": """
SELECT event_id AS request_id, ts AS start_ts, {us} AS start_us, CAST(user_id AS STRING) AS tenant,
       concat('s', CAST(user_id % 40 AS STRING)) AS session_id,
       CASE event_type WHEN 'view' THEN 'embeddings' WHEN 'purchase' THEN 'messages' WHEN 'signup' THEN 'responses' ELSE 'chat' END AS operation,
       CASE WHEN event_type = 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'Anthropic' ELSE 'AWSAnthropic' END
            ELSE CASE event_id % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'AzureOpenAI' ELSE 'GCPVertexAI' END END AS api_schema,
       concat('model-', CAST(user_id % 5 AS STRING)) AS original_model,
       CASE WHEN event_id % 4 = 0 THEN concat('model-', CAST(user_id % 5 AS STRING), '-mini') END AS model_override,
       event_type <> 'error' AS success,
       CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 500 ELSE 400 END ELSE 200 END AS status,
       event_id % 2 = 1 AND event_type <> 'view' AS stream,
       CAST(floor(value) AS BIGINT) AS input_tokens,
       CASE WHEN event_type <> 'view' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS output_tokens,
       CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) % 7 END AS cached_input_tokens,
       CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) % 11 END AS cache_creation_input_tokens,
       CASE WHEN event_type = 'signup' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 13 END AS reasoning_tokens,
       CAST(floor(value * 10) AS BIGINT) + 5 AS duration_ms
FROM {events}""",
    "sse_chunks": """
SELECT r.request_id, s.seq, (s.seq + 1) * CAST(floor(r.duration_ms / 10) AS BIGINT) AS recv_ms,
       s.seq = r.request_id % 5 AS end_of_stream,
       CASE WHEN s.seq = r.request_id % 5 THEN r.output_tokens WHEN s.seq % 2 = 1 THEN s.seq END AS output_tokens
FROM {llm_requests} r JOIN (VALUES (0),(1),(2),(3),(4)) AS s(seq) ON s.seq <= r.request_id % 5
WHERE r.stream""",
    "mcp_calls": """
SELECT event_id AS call_id, ts AS start_ts, {us} AS start_us, concat('route-', CAST(user_id % 3 AS STRING)) AS route,
       CASE event_id % 5 WHEN 4 THEN 'no-separator' ELSE concat(CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'jira' ELSE 'docs' END, '__', event_type, '__', CAST(user_id % 4 AS STRING)) END AS full_tool_name,
       CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN -32602 WHEN 1 THEN -32601 WHEN 2 THEN -32700 ELSE -32603 END END AS error_code,
       event_type = 'click' AND event_id % 7 = 0 AS is_error, CAST(floor(value) AS BIGINT) AS duration_ms
FROM {events}""",
    "filter_calls": """
SELECT event_id AS call_id, concat('route-', CAST(user_id % 3 AS STRING)) AS route,
       CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('b', CAST(event_id % 4 AS STRING)) END AS backend,
       CASE event_id % 2 WHEN 0 THEN 'Request' ELSE 'Response' END AS scope,
       event_id % 11 <> 0 AS configured, CASE WHEN event_id % 13 = 0 THEN false END AS enabled, false AS global_disable,
       CASE event_id % 3 WHEN 0 THEN 'Shadow' WHEN 1 THEN 'Enforce' ELSE '' END AS mode,
       user_id % 5 * 250 AS sample_permille, CASE WHEN user_id % 2 = 0 THEN 'Fail' END AS failure_policy,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'reject' WHEN 'view' THEN 'redact' ELSE 'pass' END AS outcome,
       ts AS start_ts, {us} AS start_us, CAST(floor(value) AS BIGINT) AS duration_ms
FROM {events}""",
    "tools": """
SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'jira' ELSE 'docs' END AS backend, concat(event_type, '_', CAST(user_id % 4 AS STRING)) AS tool FROM {events}""",
}

_NEEDS = {"sse_chunks": ["llm_requests"]}

# The chunk view without a range join: the same rows by exploding a sequence.
SPARK_CHUNKS = """
SELECT request_id, seq, (seq + 1) * CAST(floor(duration_ms / 10) AS BIGINT) AS recv_ms, seq = request_id % 5 AS end_of_stream,
       CASE WHEN seq = request_id % 5 THEN output_tokens WHEN seq % 2 = 1 THEN seq END AS output_tokens
FROM {llm_requests} LATERAL VIEW explode(sequence(0, CAST(request_id % 5 AS INT))) s AS seq
WHERE stream"""

BACKENDS = [("pt-east", "OpenAI", 0, 3), ("pt-west", "AzureOpenAI", 0, 1), ("on-demand", "GCPVertexAI", 1, 1)]
COST_RULES = [
    (0, "llm_input_token", "InputToken"),
    (1, "llm_output_token", "OutputToken"),
    (2, "llm_total_token", "TotalToken"),
    (3, "llm_input_token", "OutputToken"),
]


def with_views(*names: str) -> str:
    """``WITH ...`` prefix for a DuckDB oracle over the named views."""
    order: list[str] = []
    for n in names:
        for need in [*_NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = []
    for n in order:
        sql = VIEWS[n].replace("{us}", DUCK_US).replace("{events}", "events").replace("{llm_requests}", "llm_requests")
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ", ".join(parts) + "\n"


_SPLITS: dict[tuple[str, str], int] = {}
#: Rows of one task for tables whose rows are whole texts, which queries cut into many chunks or hand to Python.
TEXT_ROWS_PER_TASK = {"conversations": 5_000, "documents": 2_000}


class Tables:
    """Generated tables of one scale-factor folder and the views above, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """One table. Fewer input splits than cores (a small local file) are spread over the cores.

        Splits of a file do not show how many hold rows: a row group is read by one of them, and a writer may put a million
        texts into one. So tables of texts are dealt out by their number of rows, and a task's share does not grow with the table.
        """
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key, rows = (self.sf_dir, name), TEXT_ROWS_PER_TASK.get(name)
        if key not in _SPLITS:
            _SPLITS[key] = df.rdd.getNumPartitions() if rows is None else -(-df.count() // rows)
        cores = self.spark.sparkContext.defaultParallelism
        if rows is not None:
            return df.repartition(max(cores, _SPLITS[key]))
        return df.repartition(cores) if _SPLITS[key] < cores else df

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run Spark SQL over DataFrames named by ``{placeholders}``."""
        return self.spark.sql(text.replace("{us}", SPARK_US), **frames)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @cached_property
    def llm_requests(self) -> DataFrame:
        return self.sql(VIEWS["llm_requests"], events=self.events)

    @cached_property
    def sse_chunks(self) -> DataFrame:
        return self.sql(SPARK_CHUNKS, llm_requests=self.llm_requests)

    @cached_property
    def mcp_calls(self) -> DataFrame:
        return self.sql(VIEWS["mcp_calls"], events=self.events)

    @cached_property
    def filter_calls(self) -> DataFrame:
        return self.sql(VIEWS["filter_calls"], events=self.events)

    @cached_property
    def tools(self) -> DataFrame:
        return self.sql(VIEWS["tools"], events=self.events)


# --- bodies and messages built by Spark from the tables above -------------------------------------

CHAT_REQUESTS = """
WITH m AS (
  SELECT *, conv_id * 100 + turn AS request_id,
         CASE WHEN turn % 4 = 1
              THEN to_json(named_struct('role', role, 'content', array(
                     named_struct('type', 'text', 'text', text, 'image_url', NULL),
                     named_struct('type', 'image_url', 'text', NULL,
                                  'image_url', named_struct('url', concat('https://img.example/', conv_id))))))
              ELSE to_json(named_struct('role', role, 'content', text)) END AS msg,
         to_json(named_struct('role', 'assistant', 'tool_calls', array(
             named_struct('id', concat('call-', conv_id), 'type', 'function',
                          'function', named_struct('name', concat('tool_', turn),
                                                   'arguments', to_json(named_struct('q', substr(text, 1, 8)))))))) AS call_msg,
         to_json(named_struct('type', 'function', 'function', named_struct(
             'name', concat('tool_', turn), 'description', substr(text, 1, 20),
             'parameters', named_struct('type', 'object')))) AS tool
  FROM {conversations})
SELECT request_id, conv_id, turn, role, text, 'chat' AS operation, 'OpenAI' AS api_schema,
       substr(body, 1, CASE WHEN turn % 4 = 3 THEN length(body) - 1 ELSE length(body) END) AS request_body
FROM (
  SELECT *, concat('{{"model":"model-', conv_id % 5, '","stream":', conv_id % 2 = 0,
                   CASE WHEN conv_id % 4 = 0 THEN ',"stream_options":{{"include_usage":true}}' ELSE '' END,
                   ',"temperature":0.5',
                   ',"messages":[{{"role":"system","content":"be brief"}},', msg,
                   CASE WHEN turn % 4 = 2 THEN concat(',', call_msg) ELSE '' END, ']',
                   CASE WHEN turn % 4 = 2 THEN concat(',"tools":[', tool, ']') ELSE '' END, '}}') AS body
  FROM m)
"""

CHAT_RESPONSES = """
SELECT conv_id * 100 + turn AS request_id, conv_id, turn, text,
       to_json(named_struct('id', concat('r', conv_id), 'model', concat('model-', conv_id % 5),
         'choices', array(named_struct('index', 0, 'finish_reason', 'stop', 'message', named_struct(
            'role', 'assistant',
            'content', CASE WHEN turn % 3 <> 2 THEN text END,
            'tool_calls', CASE WHEN turn % 3 = 2 THEN array(
                named_struct('id', concat('a', conv_id), 'type', 'function',
                             'function', named_struct('name', 'lookup', 'arguments', to_json(named_struct('q', text)))),
                named_struct('id', concat('b', conv_id), 'type', 'function',
                             'function', named_struct('name', 'send', 'arguments', '{{}}'))) END))),
         'usage', named_struct('prompt_tokens', length(text), 'completion_tokens', turn, 'total_tokens', length(text) + turn)
       )) AS response_body
FROM {conversations} WHERE role = 'assistant'
"""

# Assistant text cut at spaces into chat stream chunks: seq 0 carries the role, the last one usage.
CHAT_CHUNKS = """
WITH p AS (
  SELECT conv_id * 100 + turn AS request_id, conv_id, turn, posexplode(split(text, '(?<= )')) AS (pos, piece),
         size(split(text, '(?<= )')) AS n
  FROM {conversations} WHERE role = 'assistant')
SELECT request_id, CAST(pos AS BIGINT) AS seq,
       to_json(named_struct(
         'id', concat('c', conv_id), 'model', concat('model-', conv_id % 5), 'created', 1700000000 + conv_id,
         'choices', array(named_struct('index', 0,
            'delta', named_struct('role', CASE WHEN pos = 0 THEN 'assistant' END, 'content', piece),
            'finish_reason', CASE WHEN pos = n - 1 AND turn % 2 = 1 THEN 'length' END)),
         'usage', CASE WHEN pos = n - 1 THEN named_struct('prompt_tokens', conv_id, 'completion_tokens', n, 'total_tokens', conv_id + n) END
       )) AS chunk
FROM p
"""


def _chat_requests(self) -> DataFrame:
    return self.sql(CHAT_REQUESTS, conversations=self.conversations)


def _chat_responses(self) -> DataFrame:
    return self.sql(CHAT_RESPONSES, conversations=self.conversations)


def _chat_chunks(self) -> DataFrame:
    return self.sql(CHAT_CHUNKS, conversations=self.conversations)


Tables.chat_requests = property(_chat_requests)
Tables.chat_responses = property(_chat_responses)
Tables.chat_chunks = property(_chat_chunks)
