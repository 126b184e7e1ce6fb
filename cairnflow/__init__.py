"""cairnflow: retrieval and document analytics written as Spark DataFrame plans."""
