"""Row layouts shared by the operators."""

from pyspark.sql import types as T

VECTORS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

GOLDEN = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("ideal_answer", T.StringType()),
        T.StructField("ideal_context", T.ArrayType(T.StringType())),
    ]
)

RESPONSE = (
    "struct<validator:string,result:string,message:string,confidence:double,metadata:string>"
)

ANSWER_SCORES = "relevance double, coherence double, accuracy double, overall_quality double"

RAG_SCORES = (
    "answer_relevance double, context_relevance double, accuracy double, overall_quality double"
)
