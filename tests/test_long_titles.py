from fundloom.plans.cleaning import QUERIES


def test_stopword_policies_count_all_tokens_of_a_title(spark, tmp_path):
    spark.createDataFrame([("soil " * 70,)], "grantname string").write.parquet(f"{tmp_path}/grants.parquet")
    assert QUERIES["text_x11_stopword_policies"](spark, str(tmp_path)).first()["n"] == 69
