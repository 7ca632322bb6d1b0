"""Fixed schemas as DDL. The order of a corpus is a column, corpus_pos, which is also the last tie-breaker."""

CAPTION_FILE = (
    "summary struct<model_path:string,image_root:string,subdir_glob:string,total_images:int,success_images:int,failed_images:int,"
    "model_load_seconds:double,average_inference_seconds:double,max_new_tokens:int>,"
    "results array<struct<image_path:string,success:string,inference_seconds:double,caption:string,error:string>>"
)
CAPTION_ROW = "image_path string, success boolean, inference_seconds double, caption string, error string"
CORPUS = "corpus_pos bigint, image_id string, image_path string, caption string, source_result_file string"
QUERY = "query_id bigint, display_query string, search_query string"
RANKED = "query_id bigint, rank int, image_id string, image_path string, score double"
REPORT = (
    "summary map<string,string>,"
    "query_results array<struct<query:string,search_query:string,expanded_english_queries:array<string>,"
    "items:array<struct<rank:string,image_id:string,image_path:string,score:double,caption:string,source_result_file:string>>>>"
)
