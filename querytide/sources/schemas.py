"""Table layouts the pipe-separated loads use. Fixed values."""

TPC_TABLES = {
    "region": "r_regionkey INT, r_name STRING, r_comment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT, n_comment STRING",
    "part": (
        "p_partkey INT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING, p_size INT, p_container STRING,"
        " p_retailprice DECIMAL(15,2), p_comment STRING"
    ),
    "supplier": (
        "s_suppkey INT, s_name STRING, s_address STRING, s_nationkey INT, s_phone STRING, s_acctbal DECIMAL(15,2),"
        " s_comment STRING"
    ),
    "partsupp": (
        "ps_partkey INT, ps_suppkey INT, ps_availqty INT, ps_supplycost DECIMAL(15,2), ps_comment STRING"
    ),
    "customer": (
        "c_custkey INT, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING, c_acctbal DECIMAL(15,2),"
        " c_mktsegment STRING, c_comment STRING"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey INT, o_orderstatus STRING, o_totalprice DECIMAL(15,2), o_orderdate DATE,"
        " o_orderpriority STRING, o_clerk STRING, o_shippriority INT, o_comment STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey INT, l_suppkey INT, l_linenumber INT, l_quantity DECIMAL(15,2),"
        " l_extendedprice DECIMAL(15,2), l_discount DECIMAL(15,2), l_tax DECIMAL(15,2), l_returnflag STRING,"
        " l_linestatus STRING, l_shipdate DATE, l_commitdate DATE, l_receiptdate DATE, l_shipinstruct STRING,"
        " l_shipmode STRING, l_comment STRING"
    ),
}

IMDB_TABLES = {
    "aka_name": (
        "id INT, person_id INT, name STRING, imdb_index STRING, name_pcode_cf STRING, name_pcode_nf STRING,"
        " surname_pcode STRING, md5sum STRING"
    ),
    "aka_title": (
        "id INT, movie_id INT, title STRING, imdb_index STRING, kind_id INT, production_year INT, phonetic_code STRING,"
        " episode_of_id INT, season_nr INT, episode_nr INT, note STRING, md5sum STRING"
    ),
    "cast_info": (
        "id INT, person_id INT, movie_id INT, person_role_id INT, note STRING, nr_order INT, role_id INT"
    ),
    "char_name": (
        "id INT, name STRING, imdb_index STRING, imdb_id INT, name_pcode_nf STRING, surname_pcode STRING, md5sum STRING"
    ),
    "comp_cast_type": "id INT, kind STRING",
    "company_name": (
        "id INT, name STRING, country_code STRING, imdb_id INT, name_pcode_nf STRING, name_pcode_sf STRING, md5sum STRING"
    ),
    "company_type": "id INT, kind STRING",
    "complete_cast": "id INT, movie_id INT, subject_id INT, status_id INT",
    "info_type": "id INT, info STRING",
    "keyword": "id INT, keyword STRING, phonetic_code STRING",
    "kind_type": "id INT, kind STRING",
    "link_type": "id INT, link STRING",
    "movie_companies": "id INT, movie_id INT, company_id INT, company_type_id INT, note STRING",
    "movie_info_idx": "id INT, movie_id INT, info_type_id INT, info STRING, note STRING",
    "movie_keyword": "id INT, movie_id INT, keyword_id INT",
    "movie_link": "id INT, movie_id INT, linked_movie_id INT, link_type_id INT",
    "name": (
        "id INT, name STRING, imdb_index STRING, imdb_id INT, gender STRING, name_pcode_cf STRING,"
        " name_pcode_nf STRING, surname_pcode STRING, md5sum STRING"
    ),
    "role_type": "id INT, role STRING",
    "title": (
        "id INT, title STRING, imdb_index STRING, kind_id INT, production_year INT, imdb_id INT, phonetic_code STRING,"
        " episode_of_id INT, season_nr INT, episode_nr INT, series_years STRING, md5sum STRING"
    ),
    "movie_info": "id INT, movie_id INT, info_type_id INT, info STRING, note STRING",
    "person_info": "id INT, person_id INT, info_type_id INT, info STRING, note STRING",
}
