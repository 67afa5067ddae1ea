"""Supply-chain footprint accounting as Spark DataFrame operators."""
