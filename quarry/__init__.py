"""An analytics engine on PySpark: evidence-based knowledge-graph completion, and corpus preparation in `llm`."""
