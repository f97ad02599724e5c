"""Declared schemas of the raw retail files. Never inferred: ids are zero-padded strings."""

from __future__ import annotations

# Column names and types of the public retail files.
TRANSACTIONS = "t_dat date, customer_id string, article_id string, price double, sales_channel_id int"
CUSTOMERS = "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age int, postal_code string"
ARTICLES = (
    "article_id string, product_code string, prod_name string, product_type_no int, product_type_name string, product_group_name string, "
    "graphical_appearance_no int, graphical_appearance_name string, colour_group_code string, colour_group_name string, "
    "perceived_colour_value_id int, perceived_colour_value_name string, perceived_colour_master_id int, perceived_colour_master_name string, "
    "department_no int, department_name string, index_code string, index_name string, index_group_no int, index_group_name string, "
    "section_no int, section_name string, garment_group_no int, garment_group_name string, detail_desc string"
)

FILES = {"transactions": "transactions_train.csv", "customers": "customers.csv", "articles": "articles.csv"}
KEYS = {"customers": "customer_id", "articles": "article_id"}
NOT_NULL = {"transactions": ("t_dat", "customer_id", "article_id"), "customers": ("customer_id",), "articles": ("article_id",)}
DECLARED = {"transactions": TRANSACTIONS, "customers": CUSTOMERS, "articles": ARTICLES}
