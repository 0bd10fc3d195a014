"""The queries of this subpackage by name, and the SQL that must give the same rows."""

from pagewright.llm.html_extract import op5_html_extract
from pagewright.llm.importance import OP12_SQL, op12_importance
from pagewright.llm.mixing import OP8_SQL, op8_mixing
from pagewright.llm.neighbours import op13_neighbours
from pagewright.llm.ngram_join import op10_ngram_join
from pagewright.llm.packing import op2_packing
from pagewright.llm.sharding import OP1_SQL, op1_sharding
from pagewright.llm.simhash import op4_simhash
from pagewright.llm.token_store import op9_token_store
from pagewright.llm.toxicity import op3_toxicity
from pagewright.llm.topk import OP7_SQL, op7_topk
from pagewright.llm.vector_codes import OP11_SQL, op11_vector_codes
from pagewright.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": lambda spark, sf_dir: op2_packing(spark, sf_dir),
    "op3_toxicity": op3_toxicity,
    "op4_simhash": lambda spark, sf_dir: op4_simhash(spark, sf_dir),
    "op5_html_extract": op5_html_extract,
    "op6_warc": op6_warc,
    "op7_topk": lambda spark, sf_dir: op7_topk(spark, sf_dir),
    "op8_mixing": op8_mixing,
    "op9_token_store": op9_token_store,
    "op10_ngram_join": op10_ngram_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance": op12_importance,
    "op13_neighbours": lambda spark, sf_dir: op13_neighbours(spark, sf_dir),
}
ORACLE_SQL = {"op1_sharding": OP1_SQL, "op6_warc": OP6_SQL, "op7_topk": OP7_SQL, "op8_mixing": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_importance": OP12_SQL}
