"""DataFrame -> DataFrame graph operators."""
