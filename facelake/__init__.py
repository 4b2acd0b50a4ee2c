"""facelake: image-embedding and vector-similarity analytics as Spark DataFrame plans."""
