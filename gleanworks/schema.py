"""Schemas of the core relations."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("sample_id", T.LongType(), False),
        T.StructField("intent", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("input_units", T.ArrayType(T.StringType())),
        T.StructField("input_unit_labels", T.ArrayType(T.IntegerType())),
        T.StructField("output_text", T.StringType()),
        T.StructField("output_units", T.ArrayType(T.StringType())),
        T.StructField("split", T.StringType()),
    ]
)
UNIT_SCORES = T.StructType(
    [
        T.StructField("sample_id", T.LongType(), False),
        T.StructField("unit_idx", T.IntegerType(), False),
        T.StructField("strategy", T.StringType(), False),
        T.StructField("intent", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("label", T.IntegerType(), False),
        T.StructField("score", T.DoubleType()),
    ]
)
_PERCENTILES = "struct<p5:double,p25:double,p50:double,p75:double,p95:double,min:double,max:double>"
_ERRORS = "struct<total_errors:int,error_rate:double,by_category:map<string,int>,samples:array<struct<index:int,message:string,retries:int>>>"
DATASETS = "id long, name string, display_name string, has_intent boolean, description string, metadata map<string,string>, created_at timestamp, updated_at timestamp"
MODELS = "id long, name string, provider string, config map<string,string>, description string, created_at timestamp"
RUNS = (
    "run_id long, name string, dataset_id long, llm_model_id long, split string, max_concurrency int, max_retries int, status string, "
    "created_at timestamp, started_at timestamp, completed_at timestamp, error_message string, metadata string, "
    "total_duration_ms double, total_llm_time_ms double, avg_sample_time_ms double, icl_strategy_name string, icl_strategy_params string, "
    "icl_permutation_id int, icl_diversity_metrics string, mean_ap double, std_ap double, n_samples_scored int, n_samples_failed int, "
    f"n_retries_total int, error_rate double, ap_percentiles {_PERCENTILES}, intent_metrics map<string,struct<mean_ap:double,n:int>>, "
    f"prompt_content map<string,string>, error_summary {_ERRORS}, tags array<string>"
)
RUN_SAMPLES = "run_id long, sample_index int, split string, intent string, ap double, scores array<double>, labels array<int>, n_sentences int, status string, sub_scores map<string,array<double>>, created_at timestamp"
DEFAULT_INTENT = "General relevancy"
