"""threadloom: DataFrame operators for threaded community text, search and click logs."""
