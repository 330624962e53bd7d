"""Three-way financial reconciliation (invoice, bank, general ledger) on Spark DataFrames."""
