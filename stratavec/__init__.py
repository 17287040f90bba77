"""stratavec: stratified, seeded sampling of attention vectors as Spark plans."""
