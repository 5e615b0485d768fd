"""Part of quernstone; see the README."""
