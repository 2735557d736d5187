"""Table schemas: every table is declared, none is inferred."""

from __future__ import annotations

CHUNKS = (
    "chunk_id string, text string, content_hash string, token_estimate int, repository_id string, "
    "repo_name string, branch string, file_path string, language string, chunk_type string, symbol string, "
    "start_line int, end_line int, commit_hash string"
)
CHUNK_VECTORS = "chunk_id string, embedding array<float>"
STATS = "num_files bigint, num_chunks bigint, num_skipped bigint, languages map<string,bigint>, bytes_indexed bigint"
WORKSPACES = "id string, name string, slug string, description string, created_at string"
REPOSITORIES = (
    "id string, workspace_id string, name string, local_path string, git_url string, branch string, status string, "
    "head_commit string, last_indexed_at string, stats string, error string, created_at string"
)
JOBS = (
    "id string, repository_id string, status string, progress double, message string, stats string, error string, "
    "created_at string, updated_at string"
)
SPANS = "array<struct<id:string,name:string,type:string,status:string,error:string,start_ms:double,end_ms:double>>"
TRACES = (
    "id string, name string, workflow string, status string, input string, output string, created_at timestamp, "
    f"latency_ms double, tags array<string>, spans {SPANS}, scores map<string,double>, metadata map<string,string>"
)
EVAL_SCORES = "example_id string, position int, metric string, score double, passed boolean, rationale string"
