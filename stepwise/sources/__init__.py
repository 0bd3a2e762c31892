"""File sources (CSV/JSON extracts, dataset census, ad hoc SQL) and sinks."""
