"""Schemas of the record tables; money is DECIMAL, absent metadata an empty text."""

ACCOUNTS = "account_id string, member_id string, type string, balance decimal(12,2), status string, opened_on date"
TRANSACTIONS = "transaction_id string, account_id string, posted_on date, amount decimal(12,2), description string, category string"
CARDS = "card_id string, member_id string, account_id string, type string, last_four string, status string"
CARD_LIMITS = "card_id string, atm decimal(12,2), purchase decimal(12,2), updated_on date"
MEMBERS = "member_id string, name string, email string, member_since date"
POLICIES = "policy_number string, status string, coverage_limits map<string,double>, created_at timestamp"
CATALOG = "filename string, doc_id string, title string, tenant string, sensitivity string, version string, effective_date string, superseded_by string"
GOLDEN = "id string, query string, type string, tenant string, access string, answer string, expected array<struct<doc_id:string,quote:string,match:string>>, fact_ids array<string>, notes string"
PROBES = "id string, source_id string, variant string, expect_cache string, query string, tenant string, corpus_version string"
TOOL_SET = "id string, kind string, member string, question string, expect_gate string, expect_tools array<string>, expect_outcome array<string>, facts array<string>, must_not array<string>, known_gap string"
NO_RETRIEVAL = "id string, query string, category string, tenant string, expected_gate string, notes string"
